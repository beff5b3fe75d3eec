"""Phrase mining, hash-tree shards and hard negatives: brute force, laws, and odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_native_operators import ODD, SCHEMA, clashing
from tidemark.llm import collocations, hard_negatives, hash_tree


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# --- phrases --------------------------------------------------------------------------------------


def phrases_of(rows, least, most, cover):
    """Plain Python over (lang, text)."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        holds = lambda o: any(o[i : i + len(w)] == w for i in range(len(o) - len(w) + 1))  # noqa: E731, B023
        if any(g == lang and len(o) > len(w) and holds(o) and 100 * b >= cover * a for (g, o), b in f.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score)
    return out


def mined(df, **kw):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(df, **kw).collect()}


@pytest.mark.parametrize(("least", "cover", "chunk"), [(5, 100, 50), (3, 60, 7), (9, 100, 100_000)])
def test_phrases_equal_brute_force(spark, least, cover, chunk):
    rng = random.Random(least)
    pieces = ["new york city", "New York", "a b a b a b", "in spite of", "ÉTÉ é", "x", "\t", ".", ",", "\n", "a b", "漢 字", "the"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choices(pieces, k=rng.randrange(30)))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("en", "in spite of" * 3), ("fr", " ".join(["a b"] * 200))]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    # small parts, chunks and filter: many partitions, crossings and false positives
    got = mined(df, least=least, cover=cover, part_mass=500, chunk=chunk, bits=1 << 12)
    want = phrases_of(rows, least, 5, cover)
    assert got == want
    assert len(want) > 3


def test_phrases_of_odd_rows(spark, odd):
    rows = [(r[2], r[1]) for r in ODD]
    df = clashing(odd, "phrase", "n", "score", "rank", "key", "part")
    assert mined(df, least=8, chunk=500) == phrases_of(rows, 8, 5, 100)
    ranked = collocations.ranked(collocations.mine(df, least=8), top=3).collect()
    for lang in {r.lang for r in ranked}:
        own = sorted((r for r in ranked if r.lang == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        keys = [(-r.score, -r.a, r.phrase.encode()) for r in own]
        assert keys == sorted(keys) and len(own) <= 3
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    for least in (5, 20, 100):
        stream = np.concatenate([rng.zipf(1.3, 20_000) % 5000, rng.integers(5000, 60_000, 40_000)]).astype(np.uint32)
        rng.shuffle(stream)
        held = collocations.Summary(len(stream) // least + 1)
        for part in np.array_split(stream, 37):
            keys, counts = np.unique(part, return_counts=True)
            again = collocations.unpack_counters(*collocations.pack_counters(keys, counts), len(keys))
            assert (again[0] == keys).all() and (again[1] == counts).all()
            held.merge(*again)
            held.settle()  # merges as often as a small memory would
        keys, counts = np.unique(stream, return_counts=True)
        assert held.lost < least
        assert len(held.keys) <= held.capacity
        assert set(keys[counts >= least].tolist()) <= set(held.frequent(least).tolist())


def test_long_text_is_cut_between_words():
    data = b"some words, and more: " * 500 + b"x" * 3000 + b" end"
    parts = list(collocations.slices(data, 100))
    assert b"".join(parts) == data and max(map(len, parts)) < 3200
    assert [w for p in parts for w in collocations.words_of(p)] == collocations.words_of(data)


# --- shards ---------------------------------------------------------------------------------------


def plain_shard(node, key):
    import hashlib

    while node.children:
        def cost(child):
            x = int(hashlib.md5(f"{hash_tree.SEED}:{child.name}:{key}".encode()).hexdigest()[:13], 16)  # noqa: B023
            return -math.log((x + 0.5) / 2**52) / child.weight

        node = min((c for c in node.children if c.weight > 0), key=cost)
    return node.shard


def placed(spark, root, n=6000):
    return {r.doc_id: r.shard for r in hash_tree.assign(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), root).collect()}


def test_descent_equals_plain_draws(spark):
    root = hash_tree.tree(weights={0: 5.0, 3: 0.0, 9: 2.5})
    got = placed(spark, root, 500)
    assert got == {i: plain_shard(root, f"i{i}") for i in range(500)}
    assert 3 not in got.values()


def test_shards_hold_their_share(spark):
    weights = {i: 1.0 + i % 3 for i in range(24)}
    count = Counter(placed(spark, hash_tree.tree(weights=weights)).values())
    whole = sum(weights.values())
    for shard, w in weights.items():
        want = 6000 * w / whole
        assert abs(count[shard] - want) < 5 * math.sqrt(want)


@pytest.mark.parametrize("joined", [0, 1, 4])
def test_joining_shard_takes_rows_only_into_itself(spark, joined):
    before, after = placed(spark, hash_tree.tree(joined=joined)), placed(spark, hash_tree.tree(joined=joined + 1))
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {24 + joined}
    assert 0.5 < len(moved) / (6000 / (25 + joined)) < 1.5


def test_changed_weight_moves_rows_only_around_its_subtree(spark):
    before, after = placed(spark, hash_tree.tree()), placed(spark, hash_tree.tree(weights={5: 3.0}))
    rack, region = {4, 5, 6, 7}, set(range(12))
    for i, shard in before.items():
        if after[i] != shard:
            # into the heavier region from the other one, into the heavier rack inside the region, or to the shard itself
            assert (shard not in region and after[i] in region) or (shard in region - rack and after[i] in rack) or (shard in rack and after[i] == 5)
    assert any(after[i] != before[i] for i in before)


def test_slots_and_digests(spark, odd):
    twice = odd.unionByName(odd).unionByName(spark.createDataFrame([(77, "hot", "en", "a", 3)] * 300, SCHEMA))
    rows = hash_tree.shards(clashing(twice, "shard", "slot", "size", "place", "copies", "range"), range_rows=7).collect()
    want = Counter()
    for r in twice.collect():
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 8, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for i, x in by_id.items() if i is not None)
    again = hash_tree.shards(twice.repartition(5), range_rows=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert hash_tree.shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_written_shards_hold_whole_documents(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    hash_tree.write(odd, path, files=2)
    got = spark.read.schema(hash_tree.assign(odd, hash_tree.tree()).schema).parquet(path)
    assert Counter(map(tuple, got.select(*odd.columns, "shard").collect())) == Counter(map(tuple, hash_tree.assign(odd, hash_tree.tree()).collect()))


# --- hard negatives -------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 8, 64, 100])
def test_subset_sums_give_exact_products(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(-(1 << 23), 1 << 23, (50, width))
    anchors = rng.integers(-(1 << 23), 1 << 23, (9, width))
    rows[0], rows[1], anchors[0] = -(1 << 23), (1 << 23) - 1, -(1 << 23)
    for own in (rows, np.zeros_like(rows), np.abs(rows) % 3, -(np.abs(rows) % 3)):
        packed = hard_negatives.pack_planes(own, hard_negatives.planes_for(own))
        assert (hard_negatives.scores(hard_negatives.subset_sums(anchors), packed) == own @ anchors.T).all()


def plain_negatives(rows, every, k=5, lowest=80):
    fine = {
        (i, str(label), tuple(math.floor(256 * x) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) and abs(x) * 256 < 1 << 23 for x in v)
    }
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, label, v in fine:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, of) for j, of, w in fine if len(w) == len(v) and (j, of, w) != (i, label, v))
        for p, pid, _ in [x for x in scored if x[2] == label and x[1] != i][:k]:
            band = [(s, j) for s, j, of in scored if of != label and lowest * -p <= 100 * -s <= 100 * -p]
            for rank, (s, j) in enumerate(band[:k], 1):
                out[i, pid, rank, j, -p, -s] += 1
    return out


def test_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    near = [[rng.choice([-0.1, 0.0, 0.1, 0.2]) for _ in range(6)] for _ in range(12)]
    rows = [(i, [float(np.float32(x)) for x in rng.choice(near)], rng.choice([0, 1, 2])) for i in range(160)]
    rows += [(200 + i, [0.3, rng.random(), -0.2], i % 2) for i in range(20)]  # another width
    rows += [(0, None, 1), (10, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (20, [math.nan] * 6, 1), (30, [math.inf] * 6, 1), (None, near[0], 1), (40, near[0], None)]
    rows += [(50, [], 1), (60, [1e30] * 6, 1), *rows[:9], (70, near[1], 2), (70, near[2], 2), (80, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    df = clashing(df, "anchor", "width", "v", "rank", "tops")
    for blocks in ({}, {"block_rows": 20, "block_anchors": 3}):
        # each cell in a task of its own, so both sides of a cell must be dealt alike
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not blocks).lower())
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **blocks).collect()
        assert Counter(map(tuple, got)) == plain_negatives(rows, 10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []


def test_one_hot_label_and_id(spark):
    rng = random.Random(6)
    rows = [(5 if i % 3 == 0 else i, [rng.uniform(-1, 1) for _ in range(4)], "hot" if i % 3 else "cold") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, block_rows=10, block_anchors=5).collect()
    assert Counter(map(tuple, got)) == plain_negatives(rows, 4)
