"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every kind has a pattern, a test of the matched text, a base score, and words that raise
the score when they stand shortly before or after the match. A match is a finding from ``THRESHOLD``
on. An account code may stand before other words in capitals, which its pattern takes along: it is the
longest beginning of the match that ends with a group and passes its checksum. The four base kinds are certain once their test holds; the added kinds need their
checksum, their context, or both, and give way to findings of the base kinds.

Positions come from what stands between the matches: the text is split by the same
pattern, and the lengths of gaps and matches are summed. Lookbehinds and possessive
quantifiers keep every pattern linear on texts without white space; they find what the
plain patterns find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, running_total
from .registry import register

THRESHOLD = 0.6
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # what any text with a match contains
    score: float
    context: str
    bonus: float
    base: bool


#: In the order of listing.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 1.0, "mail|contact|write to", 0.0, True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 1.0, "ip|address|host", 0.0, True,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 1.0, "card|visa|credit", 0.0, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 1.0, "phone|call|tel", 0.0, True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "", 0.7, "iban|account|bank", 0.2, False),
    Kind("short_card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.4, "card|visa|amex|diners|credit", 0.3, False),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.4, "ssn|social security|national id|tax id", 0.3, False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits has a valid check digit."""
    places = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, -i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
        F.lit(0),
        lambda held, d: held + d,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account code, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda held, v: F.when(v > 9, held * 100 + v).otherwise(held * 10 + v) % 97)
    return rest == 1


def _valid(kind: str, found: Column, before: Column, after: Column) -> Column:
    """The checksum or range test of a kind; ``before`` and ``after`` are the neighbouring characters."""
    alone = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    number = digits(found)
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "short_card":
        return F.when(alone & F.length(number).between(13, 15), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    if kind == "national_id":
        return alone & ~found.rlike("^(?:000|666|9[0-9]{2})|-00-|0000$")
    return F.lit(True)


def _account_length(found: Column, before: Column, after: Column) -> Column:
    """Characters of the longest beginning of a match that is an account code and ends at a blank or with the match; 0 if none is."""
    apart = ~after.rlike("^[A-Za-z0-9]")

    def holds(n: Column) -> Column:
        ends = F.when(n == F.length(found), apart).otherwise(found.substr(n + 1, F.lit(1)) == " ")
        code = F.replace(found.substr(F.lit(1), n), F.lit(" "), F.lit(""))
        return F.when(ends & F.length(code).between(15, 34), mod97(code)).otherwise(False)

    lengths = F.filter(F.sequence(F.lit(1), F.length(found)), holds)
    return F.when(before.rlike("[A-Za-z0-9]$"), 0).otherwise(F.coalesce(F.array_max(lengths), F.lit(0)))


def _kept_length(kind: str, found: Column, before: Column, after: Column) -> Column:
    """Characters of a match, from its start, that are a finding; 0 if it is none."""
    if kind == "iban":
        return _account_length(found, before, after)
    return F.when(_valid(kind, found, before, after), F.length(found)).otherwise(0)


SPAN = "struct<kind:int,start:bigint,end:bigint,score:double>"


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Findings of one kind in a text, by start."""

    def located(found: Column, gaps: Column) -> Column:
        ends = running_total(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long")))
        placed = F.zip_with(found, ends, lambda m, end: F.struct(m.alias("found"), end.alias("end")))
        near = F.transform(
            placed,
            lambda x, i: F.struct(
                x["found"].alias("found"),
                (x["end"] - F.length(x["found"])).alias("start"),
                _kept_length(kind.name, x["found"], F.get(gaps, i), F.get(gaps, i + 1)).alias("kept"),
            ),
        )
        passed = F.transform(
            F.filter(near, lambda x: x["kept"] > 0), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["kept"]).alias("end"))
        )

        def score(x: Column) -> Column:
            if not kind.bonus:
                return F.lit(kind.score)
            begin = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
            ahead = F.lower(F.substring(text, begin.cast("int") + 1, (x["start"] - begin).cast("int")))
            behind = F.lower(F.substring(text, x["end"].cast("int") + 1, F.lit(CONTEXT_CHARS)))
            near_by = ahead.rlike(kind.context) | behind.rlike(kind.context)
            return F.round(F.lit(kind.score) + F.when(near_by, kind.bonus).otherwise(0.0), 2)

        scored = F.transform(
            passed, lambda x: F.struct(F.lit(rank).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score"))
        )
        return F.filter(scored, lambda x: x["score"] >= THRESHOLD)

    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda g: located(m, g))).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.hint)), spans).otherwise(none) if kind.hint else spans


def find_spans(text: Column) -> Column:
    """All findings of a text: an array of kind (place in ``KINDS``), start, end (code points, end exclusive) and score,
    by kind, then start. Added kinds that overlap a base finding are left out."""
    whole = F.coalesce(text, F.lit(""))
    base = F.concat(*[_spans(whole, i, k) for i, k in enumerate(KINDS) if k.base])
    more = F.concat(*[_spans(whole, i, k) for i, k in enumerate(KINDS) if not k.base])

    def apart(held: Column) -> Column:
        free = F.filter(more, lambda x: ~F.exists(held, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.concat(held, free)

    return let(base, apart)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``pii_spans`` (replaced if there is one).

    Needs text; every other column comes back unchanged. A null or empty text has no
    findings; repeated rows are searched one by one; an empty table stays empty. Nothing
    is shuffled: a text is one row's work, whatever its length.
    """
    return docs.withColumn("pii_spans", find_spans(F.col("text")))


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, by start; the earliest kind names it."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def grow(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["kind"], x["kind"]).alias("kind")
        )
        return F.when(last["end"] > x["start"], F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(joined))).otherwise(
            F.concat(held, F.array(x))
        )

    start = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return let(ordered, lambda o: F.aggregate(o, start, lambda held, x: F.when(F.size(held) == 0, F.array(x)).otherwise(grow(held, x))))


def _cut(text: Column, spans: Column) -> Column:
    """``text`` with each of the merged ``spans`` (relative to it) replaced by its kind's mark."""
    marks = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])
    pieces = F.transform(
        spans,
        lambda x, i: F.concat(
            F.substring(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0).cast("int") + 1,
                        (x["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)).cast("int")),
            F.get(marks, x["kind"]),
        ),
    )
    rest = F.substring(text, F.element_at(spans, -1)["end"].cast("int") + 1, F.length(text))
    return F.concat(F.array_join(pieces, ""), rest)


def redacted(text: Column, spans: Column, group: int = 64) -> Column:
    """A text with its findings replaced by marks like <EMAIL>.

    Spans are cut in groups: each group works on its own stretch of the text, so a text with
    many findings is not walked from its start for each of them.
    """

    def by_group(all_spans: Column) -> Column:
        def one(g: Column) -> Column:
            own = F.slice(all_spans, g * group + 1, F.lit(group))
            begin = F.when(g > 0, F.get(all_spans, g * group - 1)["end"]).otherwise(0).cast("long")
            last = F.element_at(own, -1)["end"]
            stretch = F.substring(text, begin.cast("int") + 1, (last - begin).cast("int"))
            shifted = F.transform(
                own, lambda x: F.struct((x["start"] - begin).alias("start"), (x["end"] - begin).alias("end"), x["kind"].alias("kind"))
            )
            return let(stretch, lambda t: let(shifted, lambda s: _cut(t, s)))

        groups = F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / group).cast("int"))
        tail = F.substring(text, F.element_at(all_spans, -1)["end"].cast("int") + 1, F.length(text))
        return F.concat(F.array_join(F.transform(groups, one), ""), tail)

    return let(spans, lambda found: F.when(F.size(found) > 0, let(_merged(found), by_group)).otherwise(text))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding of its texts replaced by a mark, and n_chars, where there is one, made to fit.

    The columns stay as they are; null texts stay null.
    """
    cleaned = docs.withColumn("text", redacted(F.col("text"), find_spans(F.col("text"))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``detect``'s rows, one row each."""
    base = F.filter("pii_spans", lambda x: x["kind"] < len(BASE_KINDS))

    def count(rank: int) -> Column:
        return F.size(F.filter("pii_spans", lambda x: x["kind"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(BASE_KINDS)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
    )


def _check_sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        "short_card": r"[0-9]([\x20-]?[0-9])+",
        "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    luhn_sql = (
        "list_sum(list_transform(range(1, length(num) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(num, -i, 1)::INT "
        "WHEN substr(num, -i, 1)::INT > 4 THEN 2 * substr(num, -i, 1)::INT - 9 ELSE 2 * substr(num, -i, 1)::INT END)) % 10 = 0"
    )
    alone = "NOT regexp_matches(pre, '[A-Za-z0-9]$') AND NOT regexp_matches(post, '^[A-Za-z0-9]')"
    ahead, behind = "lower(text[greatest(s - 39, 1):s])", "lower(text[e + 1:e + 40])"

    def context(words: str) -> str:
        return f"(regexp_matches({ahead}, '{words}') OR regexp_matches({behind}, '{words}'))"

    code = "replace(m[1:n], ' ', '')"
    mod97_sql = (
        f"list_reduce(list_prepend(0, list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), "
        "lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE c::INT END)), "
        "lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
    )
    test = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255",
        "card": f"length(num) BETWEEN 16 AND 19 AND {luhn_sql}",
        "phone": "length(num) BETWEEN 8 AND 15",
        "iban": "NOT regexp_matches(pre, '[A-Za-z0-9]$') AND CASE WHEN n = length(m) THEN NOT regexp_matches(post, '^[A-Za-z0-9]') "
        f"ELSE m[n + 1:n + 1] = ' ' END AND length({code}) BETWEEN 15 AND 34 AND {mod97_sql}",
        "short_card": f"{alone} AND length(num) BETWEEN 13 AND 15 AND {luhn_sql} "
        f"AND {context('card|visa|amex|diners|credit')}",
        "national_id": rf"{alone} AND NOT regexp_matches(m, '^(?:000|666|9[0-9]{{2}})|-00-|0000$') "
        f"AND {context('ssn|social security|national id|tax id')}",
    }
    parts = []
    for rank, (name, pattern) in enumerate(plain.items()):
        # of an account code any beginning is tried, of all else the whole match
        lengths, longest = ("unnest(range(1, length(m) + 1))", "GROUP BY r, s") if name == "iban" else ("length(m)", "")
        end = "s + max(n)" if longest else "e"
        parts.append(rf"""
SELECT r, {rank} AS rank, '{name}' AS kind, s, {end} AS e FROM (SELECT *, {lengths} AS n FROM (
  SELECT r, text, m, pre, post, regexp_replace(m, '[^0-9]', '', 'g') AS num, off + length(pre) AS s, off + length(pre) + length(m) AS e FROM (
    SELECT r, text, ms[i] AS m, gs[i] AS pre, gs[i + 1] AS post,
           coalesce(list_sum(list_transform(gs[1:i - 1], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS off
    FROM (SELECT r, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM d)))))
WHERE {test[name]} {longest}""")
    union = " UNION ALL ".join(parts)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({union}),
g AS (SELECT * FROM f WHERE rank < 4 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.rank < 4 AND b.r = f.r AND b.s < f.e AND f.s < b.e)),
a AS (SELECT r, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
             count(*) FILTER (rank = 3) AS n_phone,
             string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY rank, s) FILTER (rank < 4) AS base,
             string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY rank, s) AS spans
      FROM g GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


@register("op8_find_pii", _check_sql())
def op8_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(documents(spark, sf_dir).select("doc_id", "text")))
