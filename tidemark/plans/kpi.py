"""Counter and KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import kpi as K
from tidemark.plans.registry import as_bigint, query
from tidemark.plans.views import view, with_views

COUNTERS = with_views("counters")
FAILS = "('FAIL_RADIO', 'FAIL_CORE', 'FAIL_AUTH')"


def counters(spark, sf):
    return view(spark, sf, "counters")


def r(x, d=2):
    return f"round(({x})::DOUBLE, {d})"


RATE = r(f"100.0::DOUBLE * succ / nullif(succ + fail, 0)")


@query("counter_15min", as_bigint(COUNTERS + """
SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, cell, counter, sum(value) AS total, avg(value) AS mean,
  max(value) AS highest, min(value) AS lowest FROM counters GROUP BY 1, 2, 3""", "total"))
def _(spark, sf):
    return K.counter_windows(counters(spark, sf), ["cell", "counter"])


@query("hierarchy_rollup", as_bigint(COUNTERS + f""", g AS (SELECT area, spectrum, carrier, cell, sum(value) AS total,
  coalesce(sum(value) FILTER (WHERE counter = 'SUCC'), 0) AS s0, sum(value) FILTER (WHERE counter = 'SUCC') AS succ0,
  sum(value) FILTER (WHERE counter IN {FAILS}) AS fail0, grouping(area, spectrum, carrier, cell) AS level_bits
  FROM counters GROUP BY ROLLUP (area, spectrum, carrier, cell))
SELECT area, spectrum, carrier, cell, total, succ0 AS succ, fail0 AS fail, level_bits,
  {r("100.0::DOUBLE * coalesce(succ0, 0) / nullif(coalesce(succ0, 0) + coalesce(fail0, 0), 0)")} AS success_pct FROM g""", "total", "succ", "fail"))
def _(spark, sf):
    return K.hierarchy_rollup(counters(spark, sf))


@query("measurement_sum", as_bigint(COUNTERS + f"""
SELECT area, carrier, coalesce(sum(value) FILTER (WHERE counter IN ('ATT', 'SUCC')), 0) AS load,
  coalesce(sum(value) FILTER (WHERE counter IN {FAILS}), 0) AS rejections FROM counters GROUP BY 1, 2""", "load", "rejections"))
def _(spark, sf):
    measures = {"load": ["ATT", "SUCC"], "rejections": K.FAILS}
    return K.measurement_sum(counters(spark, sf), measures, ["area", "carrier"])


@query("busy_hour", as_bigint(COUNTERS + """, h AS (SELECT date_trunc('hour', ts) AS h, carrier, sum(value) AS total FROM counters GROUP BY 1, 2),
x AS (SELECT CAST(h AS DATE) AS day, carrier, CAST(h AS TIMESTAMP) AS busy_at, total AS busy_total,
  row_number() OVER (PARTITION BY CAST(h AS DATE), carrier ORDER BY total DESC, h) AS rn FROM h)
SELECT day, carrier, busy_at, busy_total FROM x WHERE rn = 1""", "busy_total"))
def _(spark, sf):
    return K.busy_hour(counters(spark, sf), ["carrier"])


@query("success_rate", as_bigint(COUNTERS + f""", s AS (SELECT area, spectrum, sum(value) FILTER (WHERE counter = 'SUCC') AS succ,
  sum(value) FILTER (WHERE counter IN {FAILS}) AS fail FROM counters GROUP BY 1, 2) SELECT *, {RATE} AS success_pct FROM s""", "succ", "fail"))
def _(spark, sf):
    return K.success_rate(counters(spark, sf), ["area", "spectrum"])


DAILY_SQL = f""", d AS (SELECT CAST(ts AS DATE) AS day, carrier, sum(value) AS volume, sum(value) FILTER (WHERE counter = 'SUCC') AS succ,
  sum(value) FILTER (WHERE counter IN {FAILS}) AS fail FROM counters GROUP BY 1, 2),
dr AS (SELECT day, carrier, volume, {r("100.0::DOUBLE * coalesce(succ, 0) / nullif(coalesce(succ, 0) + coalesce(fail, 0), 0)")} AS success_pct FROM d)"""


def daily(spark, sf):
    return (
        counters(spark, sf)
        .groupBy(F.to_date("ts").alias("day"), "carrier")
        .agg(F.sum("value").alias("volume"), K.summed(["SUCC"]).alias("succ"), K.summed(K.FAILS).alias("fail"))
        .select("day", "carrier", "volume", K.ratio_pct(F.col("succ"), F.col("fail")).alias("success_pct"))
    )


@query("sla_status", as_bigint(COUNTERS + DAILY_SQL + f"""
SELECT day, carrier, volume, success_pct, {r("success_pct - lag(success_pct) OVER (PARTITION BY carrier ORDER BY day)")} AS vs_yesterday,
  {r("CAST(sum(CAST(success_pct AS DECIMAL(20,6))) OVER w AS DOUBLE) / count(success_pct) OVER w")} AS avg_7d,
  CASE WHEN success_pct >= 25 THEN 'OK' WHEN success_pct >= 20 THEN 'WARNING' ELSE 'CRITICAL' END AS status
FROM dr WINDOW w AS (PARTITION BY carrier ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""", "volume"))
def _(spark, sf):
    return K.sla_status(daily(spark, sf), ["carrier"], "success_pct", 25.0, 20.0)


@query("cause_breakdown", as_bigint(COUNTERS + f""", c AS (SELECT area, counter, sum(value) AS rejections FROM counters WHERE counter IN {FAILS} GROUP BY 1, 2)
SELECT area, counter, rejections, {r("100.0::DOUBLE * rejections / sum(rejections) OVER (PARTITION BY area)")} AS share_pct FROM c""", "rejections"))
def _(spark, sf):
    return K.cause_breakdown(counters(spark, sf), ["area"])


@query("zscore_anomaly", as_bigint(COUNTERS + DAILY_SQL + f""", z AS (SELECT day, carrier, volume, success_pct,
  {r("(volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0)", 4)} AS zscore FROM dr
  WINDOW w AS (PARTITION BY carrier ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT *, abs(zscore) > 1.5 AS anomaly FROM z""", "volume"))
def _(spark, sf):
    return K.zscore(daily(spark, sf), ["carrier"], "volume")


@query("saturation_forecast", COUNTERS + DAILY_SQL + f""", f AS (SELECT carrier, {r("regr_slope(volume, date_diff('day', DATE '1970-01-01', day))", 6)} AS slope,
  CAST(arg_max(volume, day) AS DOUBLE) AS latest, count(*) AS days, regr_slope(volume, date_diff('day', DATE '1970-01-01', day)) AS raw FROM dr GROUP BY carrier)
SELECT carrier, slope, latest, days, CASE WHEN latest >= 1000 THEN 0 WHEN slope > 0 THEN CAST(ceil((1000 - latest) / raw) AS BIGINT) END AS days_left FROM f""")
def _(spark, sf):
    return K.saturation(daily(spark, sf), ["carrier"], "volume", 1000.0)


@query("capacity_headroom", as_bigint(COUNTERS + f""", u AS (SELECT carrier, sum(value) FILTER (WHERE counter = 'SUCC') AS used, sum(value) AS capacity FROM counters GROUP BY 1),
p AS (SELECT *, {r("100.0::DOUBLE * used / capacity")} AS used_pct FROM u)
SELECT *, {r("100 - used_pct")} AS spare_pct, 100 - used_pct < 80 AS alert FROM p""", "used", "capacity"))
def _(spark, sf):
    used = counters(spark, sf).groupBy("carrier").agg(K.summed(["SUCC"]).alias("used"), F.sum("value").alias("capacity"))
    return K.headroom(used, "used", "capacity", 80.0)
