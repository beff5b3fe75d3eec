"""Queries of the order jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import mart_store
from tidemark.operators import orders as O
from tidemark.plans.registry import query
from tidemark.plans.views import AS_OF, view, with_views
from tidemark.session import scratch_path, settle


def enriched(spark, sf):
    raw = view(spark, sf, "raw_orders")
    stats = O.customer_inputs(
        view(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("cust"), "o_orderdate"),
        "cust", "o_orderdate", AS_OF,
    )
    return O.enrich(raw, view(spark, sf, "customers"), view(spark, sf, "products"), stats, AS_OF)


def base(spark, sf):
    return O.daily_base(O.mart_input(view(spark, sf, "raw_orders"), view(spark, sf, "products")))


def mart(spark, sf):
    return O.build_mart(base(spark, sf), None, AS_OF)


STATS_SQL = f"""stats AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, count(*) AS lifetime_order_count,
         date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF[:10]}') AS days_since_last_order
  FROM orders GROUP BY 1)"""

ENRICHED_SQL = STATS_SQL + f""",
joined AS (
  SELECT r.*, c.customer_name, c.email, st.lifetime_order_count, st.days_since_last_order,
         p.product_name, p.category, p.sub_category, p.cost_price,
         make_timestamp(r.event_timestamp * 1000) AS et,
         r.quantity * r.unit_price AS g,
         r.quantity * r.unit_price * (1 - r.discount_pct) AS n,
         r.quantity * coalesce(p.cost_price, 0) AS cg,
         CASE r.region WHEN 'US_EAST' THEN 0.085 WHEN 'US_WEST' THEN 0.085 WHEN 'EU' THEN 0.2
              WHEN 'APAC' THEN 0.1 ELSE 0 END::DOUBLE AS rate
  FROM raw_orders r LEFT JOIN customers c ON r.customer_id = c.id
  LEFT JOIN stats st ON c.id = st.customer_id
  LEFT JOIN products p ON r.product_id = p.product_id),
enriched AS (
  SELECT order_id, customer_id, customer_name, email AS customer_email,
         CASE WHEN is_first_order THEN 'NEW' WHEN lifetime_order_count >= 20 THEN 'VIP'
              WHEN days_since_last_order > 180 THEN 'CHURNED' ELSE 'RETURNING' END AS customer_segment,
         product_id, product_name, category, sub_category, quantity, unit_price, discount_pct,
         CASE WHEN discount_pct = 0 THEN 'NONE' WHEN discount_pct < 0.1::DOUBLE THEN 'SMALL'
              WHEN discount_pct <= 0.2::DOUBLE THEN 'MEDIUM' ELSE 'LARGE' END AS discount_tier,
         g AS gross_amount, g * discount_pct AS discount_amount, n AS net_amount, n * rate AS tax_amount,
         n * (1 + rate) AS total_amount, cg AS cost_of_goods,
         CASE WHEN n = 0 THEN 0 ELSE (n - cg) / n END AS gross_margin,
         order_status, channel, region, payment_method, is_first_order,
         CAST(et AS DATE) AS order_date, hour(et) AS order_hour, dayofweek(et) + 1 AS order_day_of_week,
         event_timestamp, TIMESTAMP '{AS_OF}' AS enriched_at
  FROM joined)"""

ENRICHED = with_views("raw_orders", "customers", "products", extra=ENRICHED_SQL)

BASE_SQL = """,
base AS (
  SELECT order_date AS report_date, region, category, channel, count(*) AS order_count,
         count(DISTINCT customer_id) AS unique_customers,
         count(*) FILTER (WHERE is_first_order) AS new_customer_orders,
         sum(CAST(gross_amount AS DECIMAL(20,6))) AS gross_revenue,
         sum(CAST(net_amount AS DECIMAL(20,6))) AS net_revenue,
         sum(CAST(discount_amount AS DECIMAL(20,6))) AS total_discount,
         CAST(sum(CAST(net_amount AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_order_value,
         CAST(sum(CAST(gross_margin AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_gross_margin
  FROM enriched WHERE order_status <> 'CANCELLED' GROUP BY 1, 2, 3, 4)"""

WINDOWED_SQL = """,
windowed AS (
  SELECT report_date, region, category, channel, net_revenue,
         sum(net_revenue) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_revenue,
         CAST(sum(net_revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE)
           / count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS revenue_7d_moving_avg,
         net_revenue - lag(net_revenue, 1) OVER w AS revenue_vs_prev_day,
         net_revenue - lag(net_revenue, 7) OVER w AS revenue_vs_prev_week
  FROM base WINDOW w AS (PARTITION BY region, category ORDER BY report_date, channel)),
rr AS (
  SELECT report_date, region, rank() OVER (PARTITION BY report_date ORDER BY sum(net_revenue) DESC) AS region_revenue_rank
  FROM base GROUP BY 1, 2),
cr AS (
  SELECT report_date, region, category,
         rank() OVER (PARTITION BY report_date, region ORDER BY sum(net_revenue) DESC) AS category_revenue_rank
  FROM base GROUP BY 1, 2, 3)"""

_MART_COLS = f"""b.report_date, b.region, b.category, b.channel, b.order_count, b.unique_customers,
         b.new_customer_orders, CAST(b.gross_revenue AS DOUBLE) AS gross_revenue,
         CAST(b.net_revenue AS DOUBLE) AS net_revenue, CAST(b.total_discount AS DOUBLE) AS total_discount,
         b.avg_order_value, b.avg_gross_margin, CAST(w.cumulative_revenue AS DOUBLE) AS cumulative_revenue,
         w.revenue_7d_moving_avg, CAST(w.revenue_vs_prev_day AS DOUBLE) AS revenue_vs_prev_day,
         CAST(w.revenue_vs_prev_week AS DOUBLE) AS revenue_vs_prev_week,
         rr.region_revenue_rank, cr.category_revenue_rank, TIMESTAMP '{AS_OF}' AS computed_at"""

MART_SQL = f""",
mart AS (
  SELECT {_MART_COLS}
  FROM base b
  JOIN windowed w ON b.report_date = w.report_date AND b.region = w.region AND b.category = w.category
       AND b.channel = w.channel
  JOIN rr ON b.report_date = rr.report_date AND b.region = rr.region
  JOIN cr ON b.report_date = cr.report_date AND b.region = cr.region AND b.category = cr.category)"""

BASE = ENRICHED + BASE_SQL
MART = BASE + WINDOWED_SQL + MART_SQL


@query("boundary_filter", with_views("order_events") + """
SELECT order_id, customer_id, quantity, unit_price, region FROM order_events
WHERE customer_id IS NOT NULL AND order_id IS NOT NULL AND quantity >= 1 AND unit_price > 0""")
def _(spark, sf):
    return O.boundary_filter(view(spark, sf, "order_events")).select(
        "order_id", "customer_id", "quantity", "unit_price", "region"
    )


@query("enrich_projection", ENRICHED + "\nSELECT * FROM enriched")
def _(spark, sf):
    return enriched(spark, sf)


@query("case_discount_tier", with_views("order_events") + """
SELECT order_id, discount_pct, CASE WHEN discount_pct IS NULL OR discount_pct = 0 THEN 'NONE'
  WHEN discount_pct < 0.1::DOUBLE THEN 'SMALL' WHEN discount_pct <= 0.2::DOUBLE THEN 'MEDIUM'
  ELSE 'LARGE' END AS discount_tier FROM order_events""")
def _(spark, sf):
    df = view(spark, sf, "order_events")
    return df.select("order_id", "discount_pct", S.discount_tier("discount_pct").alias("discount_tier"))


@query("case_customer_segment", ENRICHED + """
SELECT customer_segment, region, count(*) AS n FROM enriched GROUP BY ALL""")
def _(spark, sf):
    return enriched(spark, sf).groupBy("customer_segment", "region").agg(F.count(F.lit(1)).alias("n"))


@query("simple_case_tax", ENRICHED + """
SELECT region, count(*) AS n, CAST(sum(CAST(tax_amount AS DECIMAL(24,9))) AS DOUBLE) AS tax
FROM enriched GROUP BY ALL""")
def _(spark, sf):
    return enriched(spark, sf).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), S.exact_sum("tax_amount", "decimal(24,9)").cast("double").alias("tax")
    )


@query("left_join_dims", with_views("raw_orders", "customers", "products") + """
SELECT r.order_id, r.quantity, c.customer_name, c.email, p.product_name, p.category
FROM raw_orders r LEFT JOIN customers c ON r.customer_id = c.id
LEFT JOIN products p ON r.product_id = p.product_id""")
def _(spark, sf):
    joined = O.join_dims(
        view(spark, sf, "raw_orders"), view(spark, sf, "customers"), view(spark, sf, "products")
    )
    return joined.select("order_id", "quantity", "customer_name", "email", "product_name", "category")


@query("anti_join_idempotent", with_views("raw_orders") + """
SELECT order_id, event_timestamp FROM raw_orders r WHERE NOT EXISTS (
  SELECT 1 FROM raw_orders d WHERE d.order_id = r.order_id AND d.order_status = 'DELIVERED'
  AND CAST(make_timestamp(d.event_timestamp * 1000) AS DATE) >= DATE '2000-08-02')""")
def _(spark, sf):
    raw = view(spark, sf, "raw_orders")
    done = raw.where(
        (F.col("order_status") == "DELIVERED")
        & (S.epoch_ms_date("event_timestamp") >= F.date_sub(F.to_date(S.as_ts(AS_OF)), 365))
    )
    return O.skip_done(raw, done).select("order_id", "event_timestamp")


@query("customer_rfm_inputs", "WITH " + STATS_SQL + "\nSELECT * FROM stats")
def _(spark, sf):
    orders = view(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("cust"), "o_orderdate")
    return O.customer_inputs(orders, "cust", "o_orderdate", AS_OF)


@query("daily_base", BASE + """
SELECT * REPLACE (CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(net_revenue AS DOUBLE) AS net_revenue,
  CAST(total_discount AS DOUBLE) AS total_discount) FROM base""")
def _(spark, sf):
    return O.as_doubles(base(spark, sf))


@query("mart_build", MART + "\nSELECT * FROM mart")
def _(spark, sf):
    return mart(spark, sf)


@query("mart_refresh", MART + "\nSELECT * FROM mart")
def _(spark, sf):
    """The mart stored up to a day, then the days from it on, then late orders of an old day: equal to the mart of all facts."""
    path = scratch_path(spark, "mart")
    facts = O.mart_input(view(spark, sf, "raw_orders"), view(spark, sf, "products"))
    day, old = F.lit("2001-08-01").cast("date"), F.lit("2001-07-15").cast("date")
    late = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0
    daily = settle(O.daily_base(facts), "daily-base")
    one_day = settle(facts.where(F.col("order_date") == old), "old-day")
    listed = [r[0] for r in daily.select("report_date").distinct().collect()]
    # daily rows depend on their day's facts only, so those of the other days are taken as they are stored
    before = daily.where((F.col("report_date") < day) & (F.col("report_date") != old)).unionByName(O.daily_base(one_day.where(~late)))
    cut = date(2001, 8, 1)
    for rows, days in (
        (before, [d for d in listed if d < cut]),
        (daily, [d for d in listed if d >= cut]),
        (O.daily_base(one_day, "2001-07-15"), ["2001-07-15"]),
    ):
        if days:
            mart_store.refresh(path, rows, days, AS_OF)
    return mart_store.read_mart(spark, path)


@query("multi_key_inner_join", BASE + WINDOWED_SQL + f"""
SELECT {_MART_COLS}
FROM base b
JOIN windowed w ON b.report_date = w.report_date AND b.region IS NOT DISTINCT FROM w.region
  AND b.category IS NOT DISTINCT FROM w.category AND b.channel = w.channel
JOIN rr ON b.report_date = rr.report_date AND b.region IS NOT DISTINCT FROM rr.region
JOIN cr ON b.report_date = cr.report_date AND b.region IS NOT DISTINCT FROM cr.region
  AND b.category IS NOT DISTINCT FROM cr.category""")
def _(spark, sf):
    daily = settle(base(spark, sf), "daily-base")  # small, and read four times
    windowed = O.mart_windows(O.union_flagged(daily, None))
    ranks = O.rank_sum(daily, ["report_date"], ["region"], "net_revenue", "region_revenue_rank")
    cats = O.rank_sum(daily, ["report_date", "region"], ["category"], "net_revenue", "category_revenue_rank")
    joined = O.mart_join(daily, windowed, ranks, cats, null_safe=True)
    return O.as_doubles(joined.withColumn("computed_at", S.as_ts(AS_OF)))


def _daily(spark, sf):
    return O.to_daily(base(spark, sf))


DAILY = BASE + """,
daily AS (SELECT report_date, region, category, sum(net_revenue) AS net_revenue FROM base GROUP BY 1, 2, 3)"""


@query("running_total", DAILY + """
SELECT report_date, region, category, CAST(net_revenue AS DOUBLE) AS net_revenue,
  CAST(sum(net_revenue) OVER (PARTITION BY region, category ORDER BY report_date
    ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_revenue FROM daily""")
def _(spark, sf):
    return O.as_doubles(_daily(spark, sf).withColumn("cumulative_revenue", O.running_total("daily")))


@query("moving_avg_7", DAILY + """
SELECT report_date, region, category, CAST(sum(net_revenue) OVER w AS DOUBLE) / count(*) OVER w AS avg_7
FROM daily WINDOW w AS (PARTITION BY region, category ORDER BY report_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return _daily(spark, sf).select("report_date", "region", "category", O.moving_avg(7, "daily").alias("avg_7"))


@query("lag_delta", DAILY + """
SELECT report_date, region, category, CAST(net_revenue - lag(net_revenue, 1) OVER w AS DOUBLE) AS vs_prev,
  CAST(net_revenue - lag(net_revenue, 7) OVER w AS DOUBLE) AS vs_7
FROM daily WINDOW w AS (PARTITION BY region, category ORDER BY report_date)""")
def _(spark, sf):
    return O.as_doubles(
        _daily(spark, sf).select(
            "report_date", "region", "category",
            O.lag_delta(1, "daily").alias("vs_prev"), O.lag_delta(7, "daily").alias("vs_7"),
        )
    )


@query("rank_region", BASE + WINDOWED_SQL + "\nSELECT * FROM rr")
def _(spark, sf):
    return O.rank_sum(base(spark, sf), ["report_date"], ["region"], "net_revenue", "region_revenue_rank")


@query("rank_category", BASE + WINDOWED_SQL + "\nSELECT * FROM cr")
def _(spark, sf):
    return O.rank_sum(base(spark, sf), ["report_date", "region"], ["category"], "net_revenue", "category_revenue_rank")


@query("union_history", BASE + """
SELECT report_date, region, category, channel, CAST(net_revenue AS DOUBLE) AS net_revenue,
  report_date = DATE '2001-08-01' AS is_current FROM base
WHERE report_date = DATE '2001-08-01' OR report_date >= DATE '2001-07-03' AND report_date < DATE '2001-08-01'""")
def _(spark, sf):
    live = enriched(spark, sf)
    cols = [*O.GRAIN, "net_revenue"]
    past = O.daily_base(
        live.where(
            (F.col("order_date") >= F.date_sub(F.lit("2001-08-02").cast("date"), 30))
            & (F.col("order_date") < F.lit("2001-08-01").cast("date"))
        )
    )
    both = O.union_flagged(O.daily_base(live, "2001-08-01").select(*cols), past.select(*cols))
    return O.as_doubles(both)


@query("order_limit", MART + """
SELECT report_date, region, category, channel, region_revenue_rank, category_revenue_rank FROM mart
ORDER BY region_revenue_rank, category_revenue_rank, report_date, region, category, channel LIMIT 40""")
def _(spark, sf):
    from tidemark.operators.shaping import ordered_limit

    order = ["region_revenue_rank", "category_revenue_rank", "report_date", "region", "category", "channel"]
    return ordered_limit(mart(spark, sf).select(*order), order, 40)


@query("qc_raw_nulls", with_views("order_events") + """
SELECT count(*) AS total_rows, count(*) - count(order_id) AS null_order_id,
  count(*) - count(customer_id) AS null_customer_id, count(*) - count(product_id) AS null_product_id,
  count(*) FILTER (WHERE quantity <= 0) AS invalid_quantity, count(*) FILTER (WHERE unit_price <= 0) AS invalid_price,
  floor(100.0::DOUBLE * (count(*) - count(customer_id)) / count(*) * 100 + 0.5) / 100 AS customer_id_null_pct
FROM order_events""")
def _(spark, sf):
    return O.qc_raw_nulls(view(spark, sf, "order_events"))


@query("qc_join_hits", ENRICHED + """
SELECT count(*) AS total_enriched, count(*) - count(customer_name) AS customer_join_misses,
  count(*) - count(product_name) AS product_join_misses,
  floor(100.0::DOUBLE * (count(*) - count(customer_name)) / count(*) * 100 + 0.5) / 100 AS customer_miss_pct,
  floor(100.0::DOUBLE * (count(*) - count(product_name)) / count(*) * 100 + 0.5) / 100 AS product_miss_pct
FROM enriched""")
def _(spark, sf):
    return O.qc_join_hits(enriched(spark, sf))


@query("qc_margin", ENRICHED + """
SELECT count(*) AS margin_anomalies FROM enriched WHERE abs(gross_margin) > 1""")
def _(spark, sf):
    return O.qc_margin(enriched(spark, sf))


@query("qc_listing", MART + """
SELECT region, category, channel, report_date, net_revenue, order_count, region_revenue_rank, category_revenue_rank
FROM mart WHERE report_date = DATE '2001-07-31'
ORDER BY region_revenue_rank, category_revenue_rank, region, category, channel LIMIT 40""")
def _(spark, sf):
    return O.qc_listing(mart(spark, sf), "2001-07-31")


@query("qc_period_change", MART + """,
moves AS (SELECT report_date, region, CAST(sum(CAST(net_revenue AS DECIMAL(20,6))) AS DOUBLE) AS net_revenue,
  CAST(sum(CAST(revenue_vs_prev_week AS DECIMAL(20,6))) AS DOUBLE) AS delta_vs_last_week FROM mart GROUP BY 1, 2),
graded AS (SELECT *, round(100.0::DOUBLE * delta_vs_last_week / nullif(net_revenue - delta_vs_last_week, 0), 1)
  AS pct_change_vs_last_week FROM moves)
SELECT * FROM graded WHERE abs(pct_change_vs_last_week) > 30""")
def _(spark, sf):
    return O.qc_period_change(mart(spark, sf))


@query("conditional_counts", with_views("order_events") + """
SELECT region, count(*) AS total, count(*) FILTER (WHERE order_status = 'CANCELLED') AS cancelled,
  count(*) FILTER (WHERE discount_pct > 0.2) AS deep_discount, count(*) FILTER (WHERE quantity <= 0) AS bad_quantity
FROM order_events GROUP BY region""")
def _(spark, sf):
    from tidemark.operators.shaping import conditional_counts

    return conditional_counts(
        view(spark, sf, "order_events"),
        {
            "cancelled": F.col("order_status") == "CANCELLED",
            "deep_discount": F.col("discount_pct") > 0.2,
            "bad_quantity": F.col("quantity") <= 0,
        },
        by=["region"],
    )


@query("pct_round", with_views("order_events") + """
SELECT channel, floor(100.0::DOUBLE * count(*) FILTER (WHERE order_status = 'CANCELLED') / count(*) * 100 + 0.5) / 100
  AS cancelled_pct FROM order_events GROUP BY channel""")
def _(spark, sf):
    return view(spark, sf, "order_events").groupBy("channel").agg(
        S.pct(F.count_if(F.col("order_status") == "CANCELLED"), F.count(F.lit(1))).alias("cancelled_pct")
    )


@query("having_filter", with_views("order_events") + """
SELECT customer_id, count(*) AS n_lines FROM order_events GROUP BY 1 HAVING count(*) > 45""")
def _(spark, sf):
    from tidemark.operators.shaping import having

    df = view(spark, sf, "order_events")
    return having(df, ["customer_id"], {"n_lines": F.count(F.lit(1))}, F.col("n_lines") > 45)


@query("coalesce_default", with_views("order_events") + """
SELECT order_id, kafka_partition, coalesce(discount_pct, 0) AS discount_pct FROM order_events""")
def _(spark, sf):
    return view(spark, sf, "order_events").select(
        "order_id", "kafka_partition", S.coalesce_default("discount_pct", 0.0).alias("discount_pct")
    )


@query("nullif_div", with_views("order_events") + """
SELECT order_id, unit_price / nullif(quantity, 0) AS price_per_piece FROM order_events""")
def _(spark, sf):
    return view(spark, sf, "order_events").select(
        "order_id", S.nullif_div("unit_price", "quantity").alias("price_per_piece")
    )


@query("epoch_ms_parts", with_views("order_events") + """
SELECT order_id, CAST(t AS DATE) AS order_date, hour(t) AS order_hour, dayofweek(t) + 1 AS sunday_first,
  isodow(t) AS monday_first FROM (SELECT order_id, make_timestamp(event_timestamp * 1000) AS t FROM order_events)""")
def _(spark, sf):
    ms = "event_timestamp"
    return view(spark, sf, "order_events").select(
        "order_id", S.epoch_ms_date(ms).alias("order_date"), S.epoch_ms_hour(ms).alias("order_hour"),
        S.epoch_ms_weekday(ms).alias("sunday_first"), S.epoch_ms_weekday(ms, True).alias("monday_first"),
    )


@query("date_arith", f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) - 1 AS day_before, o_orderdate - INTERVAL 1 HOUR AS hour_before,
  CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS year_start,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF[:10]}') AS age_days FROM orders""")
def _(spark, sf):
    t = F.col("o_orderdate")
    return view(spark, sf, "orders").select(
        "o_orderkey",
        F.date_sub(F.to_date(t), 1).alias("day_before"),
        (t - F.make_dt_interval(F.lit(0), F.lit(1))).alias("hour_before"),
        F.date_trunc("year", t).alias("year_start"),
        F.date_diff(F.to_date(S.as_ts(AS_OF)), F.to_date(t)).alias("age_days"),
    )
