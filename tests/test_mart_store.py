"""The stored mart: incremental refreshes against a mart of all facts, versions, repeats and removed days."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import mart_store, orders

AS_OF = "2024-03-01 00:00:00"
START = date(2024, 1, 1)
SCHEMA = (
    "order_id string, customer_id string, region string, category string, channel string, quantity int, gross_amount double, "
    "net_amount double, discount_amount double, gross_margin double, is_first_order boolean, order_status string, order_date date"
)


def facts(spark, n_days, seed=1, skip=()):
    rng = random.Random(seed)
    out = []
    for d in range(n_days):
        for k in range(rng.randrange(1, 9)):
            net = round(rng.uniform(1, 500), 2)
            # some series pause for weeks, some rows have no category
            category = rng.choice(["A", "B", None]) if d % 11 else "C"
            row = (f"{d}-{k}", f"c{rng.randrange(5)}", rng.choice(["EU", "US"]), category, rng.choice(["WEB", "APP", "SHOP"]), 1,
                   net * 1.1, net, net * 0.1, 0.3, k == 0, rng.choice(["DONE", "DONE", "CANCELLED"]), START + timedelta(d))
            if row[0] not in skip:
                out.append(row)
    return spark.createDataFrame(out, SCHEMA)


def whole(df):
    return rows(orders.build_mart(orders.daily_base(df), None, AS_OF))


def stored(spark, path, cols):
    return rows(mart_store.read_mart(spark, path), *cols)


def base(df, *days):
    return orders.daily_base(df.where(F.col("order_date").isin(*days)))


def days(a, b):
    return [START + timedelta(d) for d in range(a, b)]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "mart")


def test_days_added_one_after_the_other_equal_the_whole_mart(spark, path):
    df = facts(spark, 14)
    cols = orders.build_mart(orders.daily_base(df), None, AS_OF).columns
    mart_store.refresh(path, base(df, *days(0, 10)), days(0, 10), AS_OF)
    for d in (10, 11, 12, 13):
        mart_store.refresh(path, base(df, START + timedelta(d)), days(d, d + 1), AS_OF)
    assert stored(spark, path, cols) == whole(df)


def test_late_facts_change_their_day_and_the_windows_after_it(spark, path):
    df, part = facts(spark, 20), facts(spark, 20, skip={"6-0", "6-1", "0-0"})
    cols = orders.build_mart(orders.daily_base(df), None, AS_OF).columns
    mart_store.refresh(path, orders.daily_base(part), days(0, 20), AS_OF)
    first = mart_store.read_mart(spark, path)
    earlier = rows(first.where(F.col("report_date") < START + timedelta(6)), *cols)
    measures = [*orders.GRAIN, "order_count", "net_revenue", "region_revenue_rank", "category_revenue_rank"]
    following = rows(first.where(F.col("report_date") > START + timedelta(6)), *measures)
    # only the facts of the day are given, the other days come from the store
    v = mart_store.refresh(path, base(facts(spark, 20, skip={"0-0"}), START + timedelta(6)), days(6, 7), AS_OF)
    now = mart_store.read_mart(spark, path)
    assert stored(spark, path, cols) == whole(facts(spark, 20, skip={"0-0"}))
    assert rows(now.where(F.col("report_date") < START + timedelta(6)), *cols) == earlier
    assert rows(now.where(F.col("report_date") > START + timedelta(6)), *measures) == following
    kept = {r.report_date: r.version for r in mart_store.manifest(spark, path).collect()}
    assert {d for d, n in kept.items() if n < v} == {d for d in kept if d < START + timedelta(6)}
    mart_store.refresh(path, base(df, START), days(0, 1), AS_OF)
    assert stored(spark, path, cols) == whole(df)


def test_repeats_change_nothing_and_empty_days_go(spark, path):
    df = facts(spark, 12)
    cols = orders.build_mart(orders.daily_base(df), None, AS_OF).columns
    one = mart_store.refresh(path, orders.daily_base(df), days(0, 12), AS_OF)
    assert mart_store.refresh(path, base(df, *days(3, 5)), days(3, 5), AS_OF) == one
    gone = START + timedelta(4)
    left = df.where(F.col("order_date") != gone)
    two = mart_store.refresh(path, base(left, gone), [gone], AS_OF)
    assert two > one and stored(spark, path, cols) == whole(left)
    assert mart_store.refresh(path, base(left, gone), [gone], AS_OF) == two
    assert rows(mart_store.read_mart(spark, path, version=one), *cols) == whole(df)
    part = mart_store.read_mart(spark, path, since="2024-01-03", until="2024-01-06")
    assert {r.report_date for r in part.collect()} <= set(days(2, 6)) - {gone}


def test_readers_never_meet_a_failed_write(spark, path):
    df = facts(spark, 8)
    cols = orders.build_mart(orders.daily_base(df), None, AS_OF).columns
    mart_store.refresh(path, base(df, *days(0, 6)), days(0, 6), AS_OF)
    before = stored(spark, path, cols)
    # a write that ended before its manifest, and a manifest without its mark
    spark.range(3).write.parquet(f"{path}/mart/v1")
    spark.createDataFrame([(START, 1)], mart_store.MANIFEST).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/manifest/v7")
    assert mart_store.versions(spark, path) == [0] and stored(spark, path, cols) == before
    mart_store.refresh(path, base(df, *days(6, 8)), days(6, 8), AS_OF)
    assert stored(spark, path, cols) == whole(df)


def test_unused_versions_are_removed(spark, path):
    df = facts(spark, 6)
    cols = orders.build_mart(orders.daily_base(df), None, AS_OF).columns
    mart_store.refresh(path, base(facts(spark, 6, skip={"0-0", "0-1"}), *days(0, 6)), days(0, 6), AS_OF)
    mart_store.refresh(path, base(df, START), days(0, 1), AS_OF)
    gone = mart_store.remove_unused(spark, path)
    assert "manifest/v0" in gone and "mart/v0" in gone
    assert mart_store.versions(spark, path) == [1] and stored(spark, path, cols) == whole(df)


def test_empty_facts_and_no_days(spark, path):
    none = orders.daily_base(facts(spark, 0))
    assert mart_store.refresh(path, none, days(0, 2), AS_OF) == -1
    with pytest.raises(FileNotFoundError):
        mart_store.read_mart(spark, path)
    with pytest.raises(ValueError, match="days"):
        mart_store.refresh(path, none, [], AS_OF)


def test_refresh_query_aggregates_all_facts_once(spark, sf_dir, monkeypatch):
    from tidemark.plans import orders as plan
    from tidemark.plans.registry import QUERIES

    read = []
    whole = plan.O.daily_base
    monkeypatch.setattr(plan.O, "daily_base", lambda facts, *a: read.append(facts.select("order_date").distinct().count()) or whole(facts, *a))
    QUERIES["mart_refresh"](spark, sf_dir)
    assert len([n for n in read if n > 1]) == 1
