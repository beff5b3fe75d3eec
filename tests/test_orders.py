from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import orders as O


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{n} {t}" for n, (_, t) in cols.items()))
    return df.select(expr.alias("x")).first().x if names else None


@pytest.mark.parametrize(
    "discount,tier",
    [(None, "NONE"), (0.0, "NONE"), (-0.1, "SMALL"), (0.05, "SMALL"), (0.10, "MEDIUM"), (0.20, "MEDIUM"), (0.21, "LARGE")],
)
def test_discount_tier_edges(spark, discount, tier):
    assert one(spark, S.discount_tier("d"), d=(discount, "double")) == tier


@pytest.mark.parametrize(
    "first,orders,days,segment",
    [(True, 50, 500, "NEW"), (False, 20, 500, "VIP"), (False, 19, 181, "CHURNED"), (False, 19, 180, "RETURNING"), (False, None, None, "RETURNING")],
)
def test_customer_segment(spark, first, orders, days, segment):
    got = one(spark, S.customer_segment("f", "o", "d"), f=(first, "boolean"), o=(orders, "long"), d=(days, "int"))
    assert got == segment


@pytest.mark.parametrize("region,rate", [("US_EAST", 0.085), ("EU", 0.20), ("APAC", 0.10), ("MARS", 0.0), (None, 0.0)])
def test_tax_rate(spark, region, rate):
    assert one(spark, S.tax_rate("r"), r=(region, "string")) == rate


def test_weekday_conventions(spark):
    monday = 1782086400000  # 2026-06-22
    assert one(spark, S.epoch_ms_weekday("m"), m=(monday, "long")) == 2
    assert one(spark, S.epoch_ms_weekday("m", True), m=(monday, "long")) == 1
    assert one(spark, S.epoch_ms_date("m"), m=(1750762023000, "long")) == date(2025, 6, 24)


def test_unknown_time_and_predicate_are_refused():
    with pytest.raises(ValueError):
        S.cutoff_time("whenever", "2024-01-01")


def test_unknown_predicate_is_refused(spark):
    with pytest.raises(ValueError):
        S.simple_predicate("a", "like", "x")


def test_safe_literal_quotes(spark):
    df = spark.createDataFrame([("O'Hara; --",), ("x",)], "n string")
    assert rows(df.where(F.col("n") == S.safe_literal("O'Hara; --"))) == [("O'Hara; --",)]


def test_half_up_goes_up_on_halves(spark):
    assert one(spark, S.half_up("x", 1), x=(0.25, "double")) == 0.3
    assert one(spark, S.pct("a", "b"), a=(1, "long"), b=(0, "long")) is None


def raw(spark):
    cols = (
        "order_id string, customer_id string, product_id string, quantity int, unit_price double, discount_pct double, "
        "order_status string, channel string, region string, payment_method string, is_first_order boolean, event_timestamp long"
    )
    return spark.createDataFrame(
        [
            ("1", "a", "p1", 2, 10.0, None, "DELIVERED", "WEB", "EU", "CARD", True, 1782086400000),
            ("2", "zz", "p9", 1, 5.0, 0.5, "DELIVERED", "WEB", "EU", "CARD", False, 1782086400000),
            ("3", "a", "p1", 1, 10.0, 1.0, "CANCELLED", "WEB", "EU", "CARD", False, 1782086400000),
            ("4", None, "p1", 1, 10.0, 0.1, "DELIVERED", "WEB", "EU", "CARD", False, 1782086400000),
            ("5", "a", "p1", 0, 10.0, 0.1, "DELIVERED", "WEB", "EU", "CARD", False, 1782086400000),
            ("6", "a", "p1", 1, 0.0, 0.1, "DELIVERED", "WEB", "EU", "CARD", False, 1782086400000),
        ],
        cols,
    )


def dims(spark):
    customers = spark.createDataFrame([(1, "x", None, None)], "id long, customer_name string, email string, phone string")
    customers = customers.withColumn("id", F.lit("a"))
    products = spark.createDataFrame(
        [("p1", "bolt", "MEDIUM", "b", 4.0)],
        "product_id string, product_name string, category string, sub_category string, cost_price double",
    )
    stats = spark.createDataFrame([("a", 25, 3)], "customer_id string, lifetime_order_count long, days_since_last_order int")
    return customers, products, stats


def test_boundary_filter_drops_malformed(spark):
    assert [r[0] for r in rows(O.boundary_filter(raw(spark)), "order_id")] == ["1", "2", "3"]


def test_enrich_keeps_unmatched_and_handles_zero_net(spark):
    got = {r.order_id: r for r in O.enrich(O.boundary_filter(raw(spark)), *dims(spark), "2026-06-23 00:00:00").collect()}
    assert len(got["1"]) == 30
    assert got["1"].customer_segment == "NEW" and got["1"].net_amount == 20.0 and got["1"].gross_margin == 0.6
    assert got["1"].tax_amount == 4.0 and got["1"].order_day_of_week == 2
    assert got["2"].customer_name is None and got["2"].product_name is None and got["2"].cost_of_goods == 0.0
    assert got["3"].net_amount == 0.0 and got["3"].gross_margin == 0.0 and got["3"].customer_segment == "VIP"


def test_skip_done_is_idempotent(spark):
    df = raw(spark)
    assert O.skip_done(df, df).count() == 0
    assert O.skip_done(df, df.limit(0)).count() == 6


def series(spark):
    data = [
        ("EU", "A", "WEB", 1, 10), ("EU", "A", "APP", 1, 5), ("EU", "A", "WEB", 2, 20), ("EU", None, "WEB", 1, 7),
        ("US", "A", "WEB", 1, 22), ("US", "B", "WEB", 2, 1),
    ]
    df = spark.createDataFrame(data, "region string, category string, channel string, d int, v int")
    return df.select(
        F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).alias("report_date"), "region", "category", "channel",
        F.col("v").cast("decimal(20,6)").alias("net_revenue"),
    )


def test_windows_as_written_and_daily(spark):
    written = O.mart_windows(O.union_flagged(series(spark), None)).where("region = 'EU' AND category = 'A'")
    got = [(r.channel, float(r.cumulative_revenue)) for r in written.orderBy("report_date", "channel").collect()]
    assert got == [("APP", 5.0), ("WEB", 15.0), ("WEB", 35.0)]
    daily = O.mart_windows(series(spark), "daily").where("region = 'EU' AND category = 'A'").orderBy("report_date").collect()
    assert [float(r.net_revenue) for r in daily] == [15.0, 20.0]
    assert float(daily[1].revenue_vs_prev_day) == 5.0


def test_window_ranks_equal_aggregate_ranks(spark):
    base = series(spark)
    ranked = O.with_ranks(base)
    by_region = rows(ranked.select("report_date", "region", "region_revenue_rank").distinct())
    assert by_region == rows(O.rank_sum(base, ["report_date"], ["region"], "net_revenue", "r"))
    by_category = rows(ranked.select("report_date", "region", "category", "category_revenue_rank").distinct())
    assert by_category == rows(O.rank_sum(base, ["report_date", "region"], ["category"], "net_revenue", "r"))


def test_ranks_tie_and_leave_a_gap(spark):
    # EU and US tie at 22 on day 1 (10 + 5 + 7 = 22), so the next region is third
    extra = spark.createDataFrame([("AP", "A", "WEB", 1)], "region string, category string, channel string, v int").select(
        F.lit("2026-01-02").cast("date").alias("report_date"), "region", "category", "channel",
        F.col("v").cast("decimal(20,6)").alias("net_revenue"),
    )
    got = O.with_ranks(series(spark).unionByName(extra)).where("report_date = '2026-01-02'")
    assert rows(got.select("region", "region_revenue_rank").distinct()) == [("AP", 3), ("EU", 1), ("US", 1)]


def test_mart_join_null_category(spark):
    base = series(spark)
    win = O.mart_windows(O.union_flagged(base, None))
    rr = O.rank_sum(base, ["report_date"], ["region"], "net_revenue", "rr")
    cr = O.rank_sum(base, ["report_date", "region"], ["category"], "net_revenue", "cr")
    assert O.mart_join(base, win, rr, cr).count() == 5
    assert O.mart_join(base, win, rr, cr, null_safe=True).count() == 6


def test_history_only_feeds_the_windows(spark):
    base = series(spark).where("report_date = '2026-01-03'").withColumns({"order_count": F.lit(1)})
    history = series(spark).where("report_date < '2026-01-03'")
    got = O.build_mart(base, history, "2026-01-04 00:00:00")
    eu = got.where("region = 'EU'").first()
    assert got.count() == 2 and eu.cumulative_revenue == 35.0 and eu.revenue_vs_prev_day == 10.0


def test_customer_sketch_close_to_exact(spark):
    live = spark.range(5000).select(
        F.lit("2026-01-01").cast("date").alias("order_date"), F.lit("EU").alias("region"), F.lit("A").alias("category"),
        F.lit("WEB").alias("channel"), F.lit("DELIVERED").alias("order_status"), (F.col("id") % 2000).cast("string").alias("customer_id"),
        F.lit(False).alias("is_first_order"), F.lit(1.0).alias("gross_amount"), F.lit(1.0).alias("net_amount"),
        F.lit(0.0).alias("discount_amount"), F.lit(0.5).alias("gross_margin"),
    )
    assert O.daily_base(live).first().unique_customers == 2000
    assert abs(O.daily_base(live, exact_customers=False).first().unique_customers - 2000) < 100
    assert O.daily_base(live, day="2026-01-02").count() == 0
