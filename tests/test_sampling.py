"""Samples of an exact size against sorting by the hash, and check runs on them."""

import hashlib
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.quality import checks as C
from tidemark.operators.quality import profile as P
from tidemark.operators.quality import sampling as S


@pytest.mark.parametrize("k", [0, 1, 37, 199, 200, 500])
def test_exact_and_the_same_for_any_partitioning(spark, monkeypatch, k):
    monkeypatch.setattr(S, "BORDER_ROWS", 3)
    df = spark.range(200).select("id", (F.col("id") % 7).alias("place"), F.lit(None).cast("string").alias("row"))
    want = sorted(range(200), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:k]
    for parts in (1, 5):
        got = S.exact_sample(df.repartition(parts), k, F.col("id"))
        assert got.columns == ["id", "place", "row"]
        assert sorted(r.id for r in got.collect()) == sorted(want)
    alone = S.exact_sample(df, k)
    assert alone.count() == min(k, 200) and rows(alone) == rows(S.exact_sample(df.repartition(4), k))


def test_repeated_rows_are_cut_to_the_size(spark, monkeypatch):
    monkeypatch.setattr(S, "BORDER_ROWS", 5)
    monkeypatch.setattr(S, "COPIES", 7)
    df = spark.range(300).select(F.when(F.col("id") < 200, -1).otherwise(F.col("id")).alias("v"), F.lit("é").alias("t"))
    every = S.exact_sample(df, 300).count(), S.exact_sample(df, 301).count()
    assert every == (300, 300)
    for k in (40, 150, 260):
        got = Counter(r.v for r in S.exact_sample(df, k).collect())
        assert sum(got.values()) == k and all(n == 1 for v, n in got.items() if v != -1)


def test_null_keys_empty_tables_and_bad_sizes(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None)], "k string, v int")
    assert S.exact_sample(df, 2, F.col("k")).count() == 2
    assert S.exact_sample(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        S.exact_sample(df, -1)


def test_every_row_has_the_same_chance(spark):
    hits = Counter()
    for seed in range(6):
        hits.update(r.id // 100 for r in S.exact_sample(spark.range(1000), 300, F.concat_ws("-", F.lit(seed), "id")).collect())
    # 180 expected of each hundred, five deviations of about 11
    assert all(125 < hits[b] < 235 for b in range(10))


def test_plan_reads_so_many_rows(spark):
    df = spark.range(1000).select("id", F.lit(None).cast("string").alias("gone"))
    ask = {"checks": [{"type": "not_null", "col": "gone"}, {"type": "unique", "col": "id"}]}
    got = C.run_plan(df, C.plan_checks({**ask, "scope": "sample", "rows": 64}, df.schema), "2026-01-01")
    assert rows(got, "check", "total", "hits", "scope") == [("not_null", 64, 64, "sample"), ("unique", 64, 64, "sample")]
    for bad in ({}, {"rows": 0}, {"rows": "10"}, {"rows": True}):
        with pytest.raises(ValueError):
            C.plan_checks({**ask, "scope": "sample", **bad}, df.schema)


def test_profile_of_so_many_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))
    got = P.sample_profile(df, "2026-01-01", exact=True, rows=80)
    assert rows(got, "column", "sampled")[0] == ("half", 80)
    assert rows(got.where("column = 'id'"), "n_distinct") == [(80,)]
    assert rows(got) == rows(P.sample_profile(df.repartition(3), "2026-01-01", exact=True, rows=80))
