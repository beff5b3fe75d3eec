"""Operators that are DataFrame expressions only, against plain Python and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, line_rules, mixing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "\n".join(f"line {i} of many words that go on and on {i * 7}" for i in range(4000))
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one", "en", "a", 3),
    (5, "a b c d e f g h " * 9, "en", None, 144),
    (5, "a b c d e f g h " * 9, "en", None, 144),
    (None, "no id here at all\nno id here at all", "de", "b", 10),
    (6, LONG, "en", "b", len(LONG)),
    (7, "é漢😀 über 😀\u00a0x\x1cy a@b.co +1 (555) 123-4567", "fr", "c", 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_running_total(spark):
    lists = [[], [5], list(range(127)), list(range(128)), list(range(129)), [3] * 1000]
    rows = spark.createDataFrame([(x,) for x in lists], "v array<bigint>").select(common.running_total(F.col("v"))).collect()
    assert [r[0] for r in rows] == [[sum(x[: i + 1]) for i in range(len(x))] for x in lists]


def test_base_counts_match_plain_python(odd):
    got = line_rules.judge(clashing(odd, "row", "line", "base", "head", "kept", "words")).collect()
    want = Counter((d, *base_of(t)) for d, t, *_ in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_lines_of_many_documents_are_lost(spark):
    def own_line(i):
        return " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j % 26) for j in range(30))

    own = [(i, f"Shared Banner 12\n{own_line(i)}", "a") for i in range(30)]
    only = [(100 + i, "shared  banner 99\n" * 10, "a") for i in range(3)]
    other = [(200 + i, f"Shared banner 12\n{own_line(i)}", "b") for i in range(24)]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(own + only + other, "doc_id bigint, text string, source string")).collect()}
    assert {got[i].n_frequent_words for i in range(30)} == {3} and all(got[i].kept for i in range(30))
    assert all(got[100 + i].n_frequent_words == 30 and not got[100 + i].kept for i in range(3))
    assert {got[200 + i].n_frequent_words for i in range(24)} == {0}  # one document short of the limit on this host


def test_frequent_lines_are_removed_and_the_rest_is_judged(spark):
    def own(i, n):
        return " ".join(f"{chr(97 + i % 26) * (1 + i // 26)}{chr(97 + j % 26)}" for j in range(n))

    banner = "Shared banner of seventeen words " + "and so on " * 4
    few = [(i, f"{own(i, 8)}\n\n{banner}", "a") for i in range(20)]  # 25 words, 17 of them shared
    many = [(100 + i, f"{banner}\n  {own(i, 30)} \nlast", "a") for i in range(5)]
    rest = [(200, banner, "b"), (201, None, "a"), (202, "", None)]
    docs = spark.createDataFrame(few + many + rest, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in line_rules.clean(clashing(docs, "row", "line", "base", "gone", "kept", "left", "doc")).collect()}
    assert len(got) == len(few + many + rest) and got[0].row == "x"
    for i in range(20):
        assert got[i].text == f"{own(i, 8)}\n" and got[i].n_words_left == 8 and not got[i].kept
    for i in range(5):
        assert got[100 + i].text == f"  {own(i, 30)} \nlast" and got[100 + i].n_words_left == 31 and got[100 + i].kept
    assert got[200].text == banner and got[201].text is None and got[202].text == ""
    judged = {r.doc_id: r for r in line_rules.judge(docs).collect()}
    assert all(judged[d].n_words_left == judged[d].n_words - judged[d].n_frequent_words == got[d].n_words_left for d in got)
    assert not any(judged[i].kept for i in range(20)) and all(judged[100 + i].kept for i in range(5))


def test_copies_of_one_document_do_not_make_its_lines_frequent(spark):
    def text(word):
        return "\n".join(" ".join(f"{word}{chr(97 + i)}{chr(97 + j)}" for j in range(12)) for i in range(12))

    once = [(1, text("a"), "s")] * 40 + [(None, text("b"), "s")] * 40
    many = [(100 + i, text("c"), "s") for i in range(40)]
    rows = line_rules.judge(spark.createDataFrame(once + many, "doc_id bigint, text string, source string")).collect()
    assert len(rows) == 120
    for r in rows:
        assert r.kept == (r.doc_id is None or r.doc_id == 1), r


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_rules.judge(none).collect() == []
    assert mixing.take(none).collect() == [] and mixing.mixed(none).collect() == []
    assert pii.detect(none).collect() == [] and pii.redact(none).collect() == []


def targets_by_rounds(sizes):
    """Shares by weight, the excess over twice a source's size given to the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = budget - sum(full.values())
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return {**full, **share}
        full.update({s: 2 * sizes[s] for s in above})


def test_mix_takes_each_target_to_the_word(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), s) for i, s in enumerate(["hot"] * 300 + ["b"] * 40 + ["c"] * 7 + [None] * 25 + ["z"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.take(df).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets_by_rounds(sizes), Counter()
    for d, t, s in rows:
        r = got[d]
        assert r.size == len(t.split()) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.take(df.repartition(2)).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_mix_ranges_of_keys_add_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 9)
    rows = [(i, "w " * (1 + i % 13), "hot" if i % 3 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    small = {r.doc_id: r.taken for r in mixing.take(df).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10**6)
    assert small == {r.doc_id: r.taken for r in mixing.take(df).collect()}


def test_mixed_rows_hold_the_words_taken(odd):
    taken = sum(r.taken for r in mixing.take(odd).collect())
    rows = mixing.mixed(clashing(odd, "taken", "size", "row", "src", "doc")).collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == taken
    assert rows[0].asDict().keys() >= {"taken", "src", "doc"} and all(r.src == "x" for r in rows)
    assert all(r.n_chars == len(r.text) or r.text in {t for _, t, *_ in ODD} for r in rows)


def test_mixed_ranks_repeated_rows_on_the_cut(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rows = [(1, "a b c", "hot")] * 60 + [(i, "x " * (i % 9), "b") for i in range(2, 60)] + [(None, "n o", None)] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    want, got = Counter(), Counter()
    for r in mixing.take(df).collect():
        want[r.source] += r.taken
    for r in mixing.mixed(df).collect():
        got[r.source] += len(r.text.split())
    assert got == want and want["hot"] % (60 * 3)  # the cut lies among the copies


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "a@b.co_x@d.ee y@z", "a@b@c.d.e. x..y@q.r-s.t", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "é😀 4111 1111 1111 1111 é 4111-1111-1111-1112",
    "4111111111111111 4111111111111111", "+1 (269) 555-3296 +12 3 +1 2 3 4 5 6 7 8 9 10 11 12 13", "pay GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33",
    "my amex card is 378282246310005 ok", "id 378282246310005 ok", "ssn 123-45-6789, 123-45-6789, ssn 000-45-6789", "x" * 50_000 + "@" + "1" * 50_000,
    "a.b." * 20_000 + "@x." + "y." * 20_000, "7 " * 30_000, " ".join(f"u{i}@h{i}.org" for i in range(700)), "+" * 5000 + "1", None, "",
]


def test_personal_data_matches_plain_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(pii.detect(clashing(df, "pii_spans", "kind"))).collect()}
    for i, text in enumerate(PERSONAL):
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text and text[:80]
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in PATTERNS] == want
        assert got[i].n_email == sum(s.startswith("email") for s in want)
    assert "iban:4:31" in got[6].spans and "iban" not in got[7].spans
    assert "short_card" in got[8].spans and "short_card" not in got[9].spans
    assert got[10].spans == "national_id:4:15,national_id:17:28"


CODES = {
    "account XK05 1212 0123 4567 8906 PAID": "iban:8:32",
    "account XK05 1212 0123 4567 8906 PAID IN FULL TODAY": "iban:8:32",
    "account XK05 1212 0123 4567 8906 now": "iban:8:32",
    "DE89 3704 0044 0532 0130 00 AND SO ON": "iban:0:27",
    "DE89370400440532013000 SENT": "iban:0:22",
    "xDE89370400440532013000 SENT": "",
    "bank DE89370400440532013000X": "",
    "DE88 3704 0044 0532 0130 00 AND SO ON": "",
    "378282246310005 is my amex card": "short_card:0:15",
    "378282246310005 " + "is " * 20 + "card": "",
    "378282246310005 is it": "",
    "219-09-9999 as NATIONAL ID": "national_id:0:11",
}


def test_account_codes_before_capitals_and_words_on_both_sides(spark):
    df = spark.createDataFrame(list(enumerate(CODES)), "doc_id bigint, text string")
    assert {t: r.spans for t, r in zip(CODES, pii.digest(pii.detect(df)).orderBy("doc_id").collect(), strict=True)} == CODES


def test_redaction_cuts_exactly_the_spans(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(PERSONAL)], "doc_id bigint, text string, n_chars int")
    spans = {r.doc_id: r.pii_spans for r in pii.detect(df).collect()}
    for r in pii.redact(df).collect():
        text = PERSONAL[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        merged = []
        for s in sorted(spans[r.doc_id], key=lambda s: s.start):
            if merged and merged[-1][1] > s.start:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s.end), min(merged[-1][2], s.kind))
            else:
                merged.append((s.start, s.end, s.kind))
        out, at = "", 0
        for a, b, k in merged:
            out += text[at:a] + f"<{pii.KINDS[k].name.upper()}>"
            at = b
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
    assert pii.redact(df).columns == df.columns
