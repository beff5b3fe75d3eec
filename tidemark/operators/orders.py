"""Order enrichment, the daily mart and its validation queries.

The raw table is read once per job: amounts are row expressions, the mart is
one aggregate and everything after it works on the small daily series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import (
    as_ts,
    customer_segment,
    discount_tier,
    epoch_ms_date,
    epoch_ms_hour,
    epoch_ms_weekday,
    exact_avg,
    exact_sum,
    half_up,
    money,
    nullif_div,
    pct,
    tax_rate,
)
from tidemark.operators.quality.checks import sketch_distinct
from tidemark.session import settle

GRAIN = ["report_date", "region", "category", "channel"]


def boundary_filter(df: DataFrame) -> DataFrame:
    """Keep well-formed orders; plain comparisons, so the scan can apply them."""
    return df.where(
        F.col("order_id").isNotNull()
        & F.col("customer_id").isNotNull()
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
    )


def customer_inputs(orders: DataFrame, customer: str, ordered_at: str, as_of) -> DataFrame:
    """Lifetime order count and days since the last order per customer."""
    return orders.groupBy(F.col(customer).alias("customer_id")).agg(
        F.count(F.lit(1)).alias("lifetime_order_count"),
        F.date_diff(F.to_date(as_ts(as_of)), F.to_date(F.max(ordered_at))).alias("days_since_last_order"),
    )


def join_dims(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Left joins to customers and products, unmatched orders kept.

    No broadcast hint: Catalyst broadcasts a dimension below its size threshold
    and otherwise shuffles, where AQE splits the partition of a hot customer or
    product (the left side of a left join may be split).
    """
    c = customers.withColumn("_cid", F.col("id").cast("string")).drop("id")
    return join_products(orders.join(c, F.col("customer_id") == F.col("_cid"), "left").drop("_cid"), products)


def join_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    p = products.withColumn("_pid", F.col("product_id").cast("string")).drop("product_id")
    return orders.join(p, F.col("product_id") == F.col("_pid"), "left").drop("_pid")


def skip_done(orders: DataFrame, done: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders whose key is not in ``done``. An anti join, not NOT IN: the latter
    would force a null-aware broadcast of the done keys whatever their size."""
    return orders.join(done.select(key), key, "left_anti")


def enrich_amounts(df: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Revenue, discount, tax and margin columns from quantity, price and discount."""
    d = F.coalesce(F.col("discount_pct"), F.lit(0.0))
    gross = F.col("quantity") * F.col("unit_price")
    net = gross * (F.lit(1) - d)
    cost = F.col("quantity") * F.coalesce(F.col("cost_price"), F.lit(0.0))
    rate = tax_rate("region", rates)
    return df.withColumns(
        {
            "discount_tier": discount_tier("discount_pct"),
            "gross_amount": gross,
            "discount_amount": gross * d,
            "net_amount": net,
            "tax_amount": net * rate,
            "total_amount": net * (F.lit(1) + rate),
            "cost_of_goods": cost,
            "gross_margin": F.when(net == 0, F.lit(0.0)).otherwise(F.try_divide(net - cost, net)),
            "discount_pct": d,
        }
    )


ENRICHED_COLUMNS = [
    "order_id", "customer_id", "customer_name", "customer_email", "customer_segment", "product_id",
    "product_name", "category", "sub_category", "quantity", "unit_price", "discount_pct",
    "discount_tier", "gross_amount", "discount_amount", "net_amount", "tax_amount", "total_amount",
    "cost_of_goods", "gross_margin", "order_status", "channel", "region", "payment_method",
    "is_first_order", "order_date", "order_hour", "order_day_of_week", "event_timestamp", "enriched_at",
]


def enrich(
    raw: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    stats: DataFrame,
    as_of,
    done: DataFrame | None = None,
) -> DataFrame:
    """raw orders -> 30-column enriched orders.

    ``stats`` is the output of :func:`customer_inputs`; it is merged into the
    customer dimension first, so the big side is joined once per dimension.
    """
    people = customers.join(
        stats.withColumnRenamed("customer_id", "_sid"), F.col("id").cast("string") == F.col("_sid"), "left"
    ).drop("_sid")
    todo = skip_done(raw, done) if done is not None else raw
    return (
        enrich_amounts(join_dims(todo, people, products))
        .withColumns(
            {
                "customer_email": F.col("email"),
                "customer_segment": customer_segment(
                    "is_first_order", "lifetime_order_count", "days_since_last_order"
                ),
                "order_date": epoch_ms_date("event_timestamp"),
                "order_hour": epoch_ms_hour("event_timestamp"),
                "order_day_of_week": epoch_ms_weekday("event_timestamp"),
                "enriched_at": as_ts(as_of),
            }
        )
        .select(*ENRICHED_COLUMNS)
    )


def mart_input(raw: DataFrame, products: DataFrame) -> DataFrame:
    """The enriched columns the mart reads, straight from raw orders: no customer
    attribute is among them, so that join (and its statistics) is left out."""
    return enrich_amounts(join_products(raw, products)).withColumn("order_date", epoch_ms_date("event_timestamp"))


def daily_base(enriched: DataFrame, day=None, exact_customers: bool = True) -> DataFrame:
    """Daily metrics per date, region, category and channel, cancelled orders excluded.

    The exact customer count makes the one shuffle carry a row per customer and
    group; with ``exact_customers=False`` a sketch counts them (about 1 %) and only
    one row per group and task moves.

    ``day`` restricts to one report date (a partition filter); without it every
    day is built. Sums stay DECIMAL until :func:`as_doubles`.
    """
    customers = F.count_distinct("customer_id") if exact_customers else sketch_distinct("customer_id")
    live = enriched.where(F.col("order_status") != "CANCELLED")
    if day is not None:
        live = live.where(F.col("order_date") == F.to_date(F.lit(day)))
    return live.groupBy(F.col("order_date").alias("report_date"), "region", "category", "channel").agg(
        F.count(F.lit(1)).alias("order_count"),
        customers.alias("unique_customers"),
        F.count_if("is_first_order").alias("new_customer_orders"),
        exact_sum("gross_amount").alias("gross_revenue"),
        exact_sum("net_amount").alias("net_revenue"),
        exact_sum("discount_amount").alias("total_discount"),
        exact_avg("net_amount").alias("avg_order_value"),
        exact_avg("gross_margin").alias("avg_gross_margin"),
    )


def as_doubles(df: DataFrame) -> DataFrame:
    """DECIMAL columns as doubles, the type the mart publishes."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
            for f in df.schema
        ]
    )


def union_flagged(current: DataFrame, history: DataFrame | None) -> DataFrame:
    """Today's rows and the history in one series, told apart by ``is_current``."""
    now = current.withColumn("is_current", F.lit(True))
    if history is None:
        return now
    past = history.withColumn("is_current", F.lit(False))
    return now.unionByName(past, allowMissingColumns=True)


def _series(grain: str) -> tuple[Window, Window]:
    if grain not in ("as_written", "daily"):
        raise ValueError("grain is 'as_written' or 'daily'")
    order = ["report_date", "channel"] if grain == "as_written" else ["report_date"]
    return Window.partitionBy("region", "category").orderBy(*order)


def to_daily(series: DataFrame) -> DataFrame:
    """Sum the channels away: one row per date, region and category."""
    return series.groupBy("report_date", "region", "category").agg(F.sum("net_revenue").alias("net_revenue"))


def running_total(grain: str = "as_written") -> Column:
    return F.sum("net_revenue").over(_series(grain).rowsBetween(Window.unboundedPreceding, 0))


def moving_avg(rows: int = 7, grain: str = "as_written") -> Column:
    w = _series(grain).rowsBetween(-(rows - 1), 0)
    return F.try_divide(F.sum("net_revenue").over(w).cast("double"), F.count("net_revenue").over(w).cast("double"))


def lag_delta(n: int, grain: str = "as_written") -> Column:
    return F.col("net_revenue") - F.lag("net_revenue", n).over(_series(grain))


def mart_windows(series: DataFrame, grain: str = "as_written") -> DataFrame:
    """Cumulative revenue, 7-row average and deltas to 1 and 7 rows back.

    ``as_written`` keeps the channel in the series and breaks date ties by
    channel, so "7" counts rows; ``daily`` first sums the channels, so it counts
    days. Both share one exchange and one sort; the input is the daily series,
    whose size grows with days and not with orders.
    """
    if grain == "daily":
        series = to_daily(series)
    return series.withColumns(
        {
            "cumulative_revenue": running_total(grain),
            "revenue_7d_moving_avg": moving_avg(7, grain),
            "revenue_vs_prev_day": lag_delta(1, grain),
            "revenue_vs_prev_week": lag_delta(7, grain),
        }
    )


def rank_sum(df: DataFrame, part: list[str], by: list[str], value: str, out: str) -> DataFrame:
    """RANK of the groups ``part + by`` by their summed value within ``part``."""
    w = Window.partitionBy(*part).orderBy(F.col("_total").desc())
    return (
        df.groupBy(*part, *by)
        .agg(F.sum(value).alias("_total"))
        .withColumn(out, F.rank().over(w))
        .drop("_total")
    )


def with_ranks(df: DataFrame) -> DataFrame:
    """Region rank per date and category rank per date and region.

    The groups are ranked and joined back, null keys included, so ``df`` is read three times: give a stored frame.
    """
    regions = rank_sum(df, ["report_date"], ["region"], "net_revenue", "region_revenue_rank")
    categories = rank_sum(df, ["report_date", "region"], ["category"], "net_revenue", "category_revenue_rank")
    ranked = _joined(df, regions, ["report_date", "region"], null_safe=True)
    return _joined(ranked, categories, ["report_date", "region", "category"], null_safe=True)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    """Inner join on the keys; ``null_safe`` lets null keys meet."""
    if not null_safe:
        return left.join(right, keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    tests = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, tests).drop(*[f"_r_{k}" for k in keys])


def mart_join(
    base: DataFrame, windowed: DataFrame, region_ranks: DataFrame, category_ranks: DataFrame, null_safe: bool = False
) -> DataFrame:
    """Inner joins of base, windowed series and both rank frames on 4, 2 and 3 keys.

    As written, rows with a null key (a category of an unknown product) fall
    out; ``null_safe`` keeps them with null-safe equality.
    """

    extra = [c for c in windowed.columns if c in GRAIN or c not in base.columns]
    out = _joined(base, windowed.where("is_current").select(*extra).drop("is_current"), GRAIN, null_safe)
    out = _joined(out, region_ranks, ["report_date", "region"], null_safe)
    return _joined(out, category_ranks, ["report_date", "region", "category"], null_safe)


def build_mart(
    base: DataFrame, history: DataFrame | None, as_of, null_safe: bool = False, grain: str = "as_written"
) -> DataFrame:
    """The 19-column mart from the daily base and earlier mart rows.

    The windows carry the base columns along. Their result, of days x grain rows, is stored once and
    ranked from there. ``null_safe=False`` drops rows with a null key, as the joins would.
    """
    if grain == "daily":
        raise ValueError("the mart keeps the channel; use mart_windows(grain='daily') for daily series")
    past = None if history is None else history.select(*GRAIN, money("net_revenue").alias("net_revenue"))
    current = mart_windows(union_flagged(base, past)).where("is_current").drop("is_current")
    ranked = with_ranks(settle(current, "mart-series"))
    if not null_safe:
        ranked = ranked.dropna(subset=GRAIN)
    return as_doubles(ranked.withColumn("computed_at", as_ts(as_of)))


def qc_raw_nulls(raw: DataFrame) -> DataFrame:
    miss = F.count_if(F.col("customer_id").isNull())
    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("order_id").isNull()).alias("null_order_id"),
        miss.alias("null_customer_id"),
        F.count_if(F.col("product_id").isNull()).alias("null_product_id"),
        F.count_if(F.col("quantity") <= 0).alias("invalid_quantity"),
        F.count_if(F.col("unit_price") <= 0).alias("invalid_price"),
        pct(miss, F.count(F.lit(1))).alias("customer_id_null_pct"),
    )


def qc_join_hits(enriched: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    no_customer = F.count_if(F.col("customer_name").isNull())
    no_product = F.count_if(F.col("product_name").isNull())
    return enriched.agg(
        total.alias("total_enriched"),
        no_customer.alias("customer_join_misses"),
        no_product.alias("product_join_misses"),
        pct(no_customer, total).alias("customer_miss_pct"),
        pct(no_product, total).alias("product_miss_pct"),
    )


def qc_margin(enriched: DataFrame, bound: float = 1.0) -> DataFrame:
    m = F.col("gross_margin")
    return enriched.agg(F.count_if((m < -bound) | (m > bound)).alias("margin_anomalies"))


def qc_listing(mart: DataFrame, day, n: int = 40) -> DataFrame:
    """Best-ranked regions and categories of one day; a top-n report."""
    return (
        mart.where(F.col("report_date") == F.to_date(F.lit(day)))
        .select(
            "region", "category", "channel", "report_date", "net_revenue", "order_count",
            "region_revenue_rank", "category_revenue_rank",
        )
        .orderBy("region_revenue_rank", "category_revenue_rank", "region", "category", "channel")
        .limit(n)
    )


def qc_period_change(mart: DataFrame, limit: float = 30.0) -> DataFrame:
    """Regions whose revenue moved by more than ``limit`` percent against the week before."""
    net, delta = exact_sum("net_revenue"), exact_sum("revenue_vs_prev_week")
    change = nullif_div(F.lit(100.0) * F.col("delta_vs_last_week"), F.col("net_revenue") - F.col("delta_vs_last_week"))
    return (
        mart.groupBy("report_date", "region")
        .agg(net.cast("double").alias("net_revenue"), delta.cast("double").alias("delta_vs_last_week"))
        .withColumn("pct_change_vs_last_week", half_up(change, 1))
        .where(F.abs("pct_change_vs_last_week") > limit)
    )
