"""The stored search index: searches, families and resolution against brute force in plain Python, updates and compaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.names import STOP_WORDS
from tidemark.operators import search_index as S
from tidemark.operators.catalog import keyword_rank

ASSETS = "asset_id string, asset_type string, name string, description string, score int"
FIELDS = "asset_id string, ordinal int, name string, type string, query string"
WORDS = ["order", "orders", "ring", "rings", "spring", "customer", "geo", "geology", "lat", "plate", "mail", "x9", "ab", "abc", "ssn", "date"]
KINDS = ["iceberg_table", "kafka_topic", "ozone_volume"]


def catalog(n, seed=1):
    """(asset row, its field names): a third of all names hold the word hot, some are copies, some null or empty."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 4))] + (["hot"] if i % 3 == 0 else [])
        name = None if i % 97 == 96 else "" if i % 89 == 88 else rng.choice("._-").join(words) + rng.choice(["", str(rng.randrange(40))])
        described = rng.choice([None, "", "About the Plate of " + rng.choice(WORDS)])
        names = [rng.choice(["Order_ID", "e-mail", "latitude", "created_at", "x", "ssn", "hot_spring2"]) for _ in range(rng.randrange(4))]
        out.append(((f"a{i}", rng.choice(KINDS), name, described, -7), names + ([None] if i % 50 == 0 else [])))
    return out


def frames(spark, made):
    assets = spark.createDataFrame([a for a, _ in made], ASSETS)
    fields = spark.createDataFrame([(a[0], j, f, "string", "given") for a, fs in made for j, f in enumerate(fs)], FIELDS)
    return assets, fields


def words_of(text):
    spaced = re.sub(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ", (text or "").lower())
    return {t for t in re.split("[^a-z0-9]+", spaced) if len(t) > 1 and t not in STOP_WORDS}


def ranked(made, text, k):
    scored = []
    for (asset_id, _, name, _, _), fields in made:
        own, theirs = words_of(name), set().union(*[words_of(f) for f in fields])
        points = sum(3 if q in own else 2 if any(q in n or n in q for n in own) else 1 if q in theirs else 0 for q in words_of(text))
        if points:
            scored.append((-points, name is not None, name, asset_id))
    return [(text, i + 1, a, n, -p) for i, (p, _, n, a) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or "", s[3]))[:k])]


QUERIES = ["hot", "hot spring", "hot ring 12", "find the hot orders", "order customer mail", "geologys", "springs x9 abcd", "lat", "me the", "", "zzz", "created hot at", "ri", "ssn date plate hot order"]


def asked(spark, texts):
    return spark.createDataFrame([(t, 1) for t in texts], "query string, score int")


def found(index, spark, texts=QUERIES, k=5):
    return sorted(tuple(r) for r in index.search(asked(spark, [*texts, *texts[:3], None]), k).select("query", "rank", "asset_id", "name", "score").collect())


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    made = catalog(10_000)
    path = str(tmp_path_factory.mktemp("index"))
    S.build(path, *frames(spark, made))
    return made, S.Index(spark, path)


def test_search_equals_brute_force(spark, large):
    made, index = large
    for k in (1, 5, 40):
        assert found(index, spark, k=k) == sorted(r for t in QUERIES for r in ranked(made, t, k))


def test_search_equals_the_scan_of_the_catalog(spark, large):
    made, index = large
    assets, fields = frames(spark, made)
    scan = [(r.asset_id, r.score) for r in keyword_rank(assets, fields, "hot spring2 mail", 9).collect()]
    assert [(r[2], r[4]) for r in found(index, spark, ["hot spring2 mail"], 9)] == scan


def test_plans_read_the_index_only(large, spark):
    _, index = large
    plan = index.word_hits(asked(spark, ["hot"]).select(F.col("query").alias("word")))._jdf.queryExecution().toString()
    assert f"{index.path}/postings" in plan and "LogicalRDD [asset_id" not in plan


def test_families_equal_brute_force(spark, large):
    made, index = large
    texts = ["Geolocation", "email  hot", "PII", "date ring", "r", "created_at", "-mail", "  ", "nothing_like_it"]
    want = []
    for text in texts:
        keys = set(text.lower().split())
        for (asset_id, kind, name, described, _), given in made:
            fields = [f.lower() for f in given if f]
            label = " ".join(t for t in (name, described) if t is not None).lower()
            by_name = any(k in label for k in keys)
            hits = sorted({f for f in fields if any(k in f for k in keys)})
            family = kind == "iceberg_table" and any(p in f for k in keys for p in S.KEYWORD_FIELDS.get(k, []) for f in fields)
            if by_name or hits or family:
                want.append((text, asset_id, kind, name, by_name, bool(hits), family, sum(k in (name or "").lower() for k in keys), ",".join(hits)))
    got = [tuple(r) for r in index.families(asked(spark, texts)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_resolution_in_three_steps(spark, large):
    made, index = large
    by_kind = {k: {} for k in KINDS}
    for (asset_id, kind, name, _, _), _ in made:
        if name:
            by_kind[kind][name] = min(asset_id, by_kind[kind].get(name, asset_id))
    table = min(by_kind["iceberg_table"])
    topic = min(set(by_kind["kafka_topic"]) - set(by_kind["iceberg_table"]))
    typed = [table, topic, table, "the hot geologys", "", "qqq", None]
    names = spark.createDataFrame([(t, "given", 4) for t in typed], "typed string, asset_id string, rank int")
    got = sorted([(r.typed, r.asset_id, r.resolved_as, r["rank"]) for r in index.resolve(names).collect()], key=str)
    best = ranked(made, "the hot geologys", 1)[0][2]
    want = [(table, by_kind["iceberg_table"][table], "table", 4)] * 2 + [
        (topic, by_kind["kafka_topic"][topic], "topic", 4), ("the hot geologys", best, "search", 4),
        ("", None, None, 4), ("qqq", None, None, 4), (None, None, None, 4),
    ]
    assert got == sorted(want, key=str)


def test_updates_replace_add_and_remove(spark, tmp_path):
    first, second = catalog(300, 3), catalog(300, 4)
    path = str(tmp_path / "index")
    S.build(path, *frames(spark, first))
    before = S.Index(spark, path)
    held = found(before, spark)
    # 40 changed (some named twice), 20 new, 30 removed
    changed = second[:40] + [((f"n{i}", *a[1:]), fs) for i, (a, fs) in enumerate(second[100:120])]
    S.update(path, *frames(spark, changed + changed[:5]), removed=spark.createDataFrame([(f"a{i}",) for i in range(200, 230)], "asset_id string"))
    now = changed + first[40:200] + first[230:]
    want = sorted(r for t in QUERIES for r in ranked(now, t, 5))
    assert found(S.Index(spark, path), spark) == want
    assert found(before, spark) == held  # a reader keeps its version
    S.compact(spark, path)
    index = S.Index(spark, path)
    assert len(index.live) == 1 and found(index, spark) == want
    # an id that went comes back
    S.update(path, *frames(spark, first[200:210]))
    assert found(S.Index(spark, path), spark) == sorted(r for t in QUERIES for r in ranked(now + first[200:210], t, 5))


def test_a_generation_without_manifest_is_not_read(spark, tmp_path):
    made = catalog(60, 5)
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        S.update(path, *frames(spark, made))
    S.build(path, *frames(spark, made[:40]))
    S.postings_of(*frames(spark, made)).write.parquet(f"{path}/postings/g1")  # a writer that was lost
    assert S.Index(spark, path).live == [0]
    S.update(path, *frames(spark, made[40:]))
    assert found(S.Index(spark, path), spark) == sorted(r for t in QUERIES for r in ranked(made, t, 5))


def test_empty_catalog_and_long_names(spark, tmp_path):
    path = str(tmp_path / "index")
    none = frames(spark, catalog(1))
    S.build(path, none[0].limit(0), none[1].limit(0))
    index = S.Index(spark, path)
    assert found(index, spark) == [] and rows(index.families(asked(spark, ["hot"]))) == []
    long_name = "q" * 20_000 + ".hot"
    S.update(path, *frames(spark, [(("a", "kafka_topic", long_name, None, 0), [])]))
    index = S.Index(spark, path)
    assert [r[2] for r in found(index, spark, ["qqqq", "q" * 30_000, "hots"], 3)] == ["a", "a", "a"]


def test_pieces_are_cut_by_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    names = [(f"a{i}", "iceberg_table", f"lake.table_{i}", "") for i in range(400)]
    assets = spark.createDataFrame(names, "asset_id string, asset_type string, name string, description string").coalesce(1)
    fields = spark.createDataFrame([("a1", "zip_code")], "asset_id string, name string")
    S.build(str(tmp_path), assets, fields)
    cut = spark.read.parquet(f"{tmp_path}/grams/g0")
    assert len(cut.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {(r.term, r.gram) for r in cut.where("is_key").collect()}
    assert {t for t, _ in keys} == {r.term for r in cut.where("kind = 'token'").select("term").distinct().collect()}
    assert len(keys) == len({t for t, _ in keys}) and all(g in t for t, g in keys)


def test_short_needles_are_found_inside_pieces(spark, tmp_path):
    names = ["a", "ab", "abc", "xab_y", "b.c", "q", "zz"]
    assets = spark.createDataFrame([(f"i{n}", "iceberg_table", t, "") for n, t in enumerate(names)], "asset_id string, asset_type string, name string, description string")
    S.build(str(tmp_path), assets, spark.createDataFrame([], "asset_id string, name string"))
    index = S.Index(spark, str(tmp_path))
    needles = ["a", "b", "ab", "bc", "xab", "c", "k", "zz", "zzz"]
    asked = spark.createDataFrame([("text", n) for n in needles], "kind string, needle string")
    stored = [r.term for r in index.postings().where("kind = 'text'").collect()]
    want = sorted(("text", n, t) for n in needles for t in stored if n in t)
    assert rows(index.containing(asked)) == want
    cut = spark.read.parquet(f"{tmp_path}/grams/g0")
    assert cut.where("length(gram) < least(3, length(term))").isEmpty()  # no piece that a longer one holds


def test_only_the_first_of_assets_that_hit_alike_are_scored(spark, tmp_path):
    assets = [(f"a{i:03}", "iceberg_table", f"red lamp {i:03}", "d", None) for i in range(200)]
    made = [(a, ["hot spring", "email"]) for a in assets]
    # repeats of assets and fields, and two assets without a name, which no text finds
    made += made[:20] + [((f"n{i}", "iceberg_table", None, "d", None), ["red", "lamp"]) for i in range(2)]
    path = str(tmp_path / "alike")
    S.build(path, *frames(spark, made))
    index = S.Index(spark, path)
    stored = index.postings()
    assert stored.count() == stored.distinct().count()
    hits = index.word_hits(spark.createDataFrame([("red",), ("lamp",), ("email",)], "word string"))
    assert hits.where("name is not null").count() == 600
    assert rows(index._leading(hits, 3).select("asset_id").distinct()) == [("a000",), ("a001",), ("a002",)]
    got = index.search(asked(spark, ["red lamp"]), 3).select("rank", "asset_id", "score")
    assert rows(got) == [(1, "a000", 6), (2, "a001", 6), (3, "a002", 6)]


def test_terms_are_met_before_replaced_ids(spark, tmp_path):
    first, second = catalog(200, 5), catalog(100, 6)
    path = str(tmp_path / "steps")
    S.build(path, *frames(spark, first))
    S.update(path, *frames(spark, second))
    index = S.Index(spark, path)
    terms = index.postings().select("kind", "term").distinct().where("kind = 'token'").orderBy("term").limit(7).withColumn("more", F.lit(1))
    want = index.postings().join(terms, ["kind", "term"])
    got = index.postings(terms)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *want.columns) == rows(want) != []
