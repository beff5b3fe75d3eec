"""Queries on job health, decisions, retries, lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import health as O
from tidemark.operators import shaping as H
from tidemark.plans.registry import query
from tidemark.plans.views import EVENTS_AS_OF, view, with_views

METRICS = with_views("job_metrics")


@query("job_health", METRICS + """
SELECT sample_id, job_id, CASE WHEN consumer_lag > 100000 OR error_rate > 0.1::DOUBLE THEN 'critical'
  WHEN consumer_lag > 50000 OR error_rate > 0.05::DOUBLE THEN 'degraded' ELSE 'healthy' END AS state FROM job_metrics""")
def _(spark, sf):
    return O.health(view(spark, sf, "job_metrics")).select("sample_id", "job_id", "state")


_DIAG = """diag AS (SELECT sample_id, CASE WHEN consumer_lag > 100000 THEN 'consumer_lag_excessive' WHEN error_rate > 0.1::DOUBLE
    THEN 'high_error_rate' ELSE 'unknown' END AS root_cause, CASE WHEN consumer_lag > 100000 THEN 0.95 WHEN error_rate > 0.1::DOUBLE
    THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN consumer_lag > 100000 THEN 'restart_consumers'
    WHEN error_rate > 0.1::DOUBLE THEN 'scale_workers' ELSE 'escalate_to_ops' END AS suggested_fix FROM job_metrics)"""
DIAG = with_views("job_metrics", extra=_DIAG)


@query("diagnose", DIAG + "SELECT * FROM diag")
def _(spark, sf):
    return O.diagnose(view(spark, sf, "job_metrics")).select("sample_id", "root_cause", "confidence", "suggested_fix")


@query("heal_or_escalate", DIAG + """
SELECT sample_id, CASE WHEN confidence > 0.7 THEN suggested_fix ELSE 'escalate' END AS action,
  CASE WHEN suggested_fix = 'scale_workers' THEN 1.5 END::DOUBLE AS scale_factor FROM diag""")
def _(spark, sf):
    return O.heal_or_escalate(O.diagnose(view(spark, sf, "job_metrics"))).select("sample_id", "action", "scale_factor")


@query("decision_stats", with_views("decisions") + """
SELECT agent_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS n_success,
  count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM decisions GROUP BY 1""")
def _(spark, sf):
    return O.decision_stats(view(spark, sf, "decisions"))


@query("status_counts", with_views("decisions") + """
SELECT agent_id, decision_type, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS n_success,
  count(*) FILTER (WHERE status = 'fail') AS n_fail FROM decisions GROUP BY ALL""")
def _(spark, sf):
    return H.status_counts(view(spark, sf, "decisions"), ["agent_id", "decision_type"], "status", ["success", "fail"])


@query("retry_schedule", f"""
WITH t AS (SELECT event_id AS task_id, ts AS failed_at, CAST(user_id % 4 AS INT) AS attempt FROM events)
SELECT task_id, attempt, CASE WHEN attempt < 3 THEN failed_at + to_seconds(CAST(pow(2, attempt) AS BIGINT)) END AS next_retry,
  CASE WHEN attempt >= 3 THEN 'exhausted' WHEN failed_at + to_seconds(CAST(pow(2, attempt) AS BIGINT)) <= TIMESTAMP '2024-01-15 00:00:00'
  THEN 'ready' ELSE 'pending' END AS state FROM t""")
def _(spark, sf):
    tasks = view(spark, sf, "events").select(
        F.col("event_id").alias("task_id"), F.col("ts").alias("failed_at"), (F.col("user_id") % 4).cast("int").alias("attempt")
    )
    return O.retry_schedule(tasks, "2024-01-15 00:00:00").drop("failed_at")


@query("ingest_advice", with_views("assets") + """
SELECT asset_id, CASE asset_type WHEN 'kafka_topic' THEN 'Kafka Connect' WHEN 'iceberg_table' THEN 'Flink SQL' WHEN 'ozone_volume'
  THEN 'NiFi' ELSE 'Spark Streaming' END AS route, CASE asset_type WHEN 'ozone_volume' THEN 'Parquet' ELSE 'Iceberg' END AS target_format
FROM assets""")
def _(spark, sf):
    return O.ingest_advice(view(spark, sf, "assets")).select("asset_id", "route", "target_format")


@query("threshold_monitor", METRICS + """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, max(consumer_lag) AS max_lag,
  floor(quantile_cont(write_ms, 0.75) * 1000000 + 0.5) / 1000000 AS p75_write_ms,
  CAST(sum(CAST(error_rate AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS error_rate,
  CASE WHEN max(consumer_lag) > 10000 THEN 'WARNING' ELSE 'OK' END AS lag_status,
  CASE WHEN quantile_cont(write_ms, 0.75) > 500 THEN 'WARNING' ELSE 'OK' END AS write_status,
  CASE WHEN CAST(sum(CAST(error_rate AS DECIMAL(20,6))) AS DOUBLE) / count(*) > 0.01::DOUBLE THEN 'WARNING' ELSE 'OK' END AS error_status
FROM job_metrics GROUP BY 1""")
def _(spark, sf):
    return O.threshold_monitor(view(spark, sf, "job_metrics"))


@query("consumer_lag", with_views("progress") + """
SELECT consumer_group, topic, CAST(sum(end_offset - committed_offset) AS BIGINT) AS total_lag, count(*) AS partitions,
  CASE WHEN sum(end_offset - committed_offset) >= 10000 THEN 'LAGGING' ELSE 'OK' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY consumer_group, topic, partition_id ORDER BY ts DESC, event_id DESC) AS rn FROM progress)
WHERE rn = 1 GROUP BY 1, 2""")
def _(spark, sf):
    return O.consumer_lag(view(spark, sf, "progress"))


@query("relative_time_filter", "\nUNION ALL\n".join(
    f"SELECT '{spec}' AS spec, count(*) AS n FROM events WHERE ts >= {bound}"
    for spec, bound in [
        ("last 36 hours", f"TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 36 HOUR"), ("last 90 minutes", f"TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 90 MINUTE"),
        ("last 5 days", f"TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 5 DAY"), ("last week", f"TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY"),
        ("last month", f"TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY"), ("this year", "TIMESTAMP '2024-01-01'"), ("today", "TIMESTAMP '2024-01-30'"),
    ]))
def _(spark, sf):
    from tidemark.functions.scalar import relative_time

    ev = view(spark, sf, "events")
    asked = {
        "last 36 hours": EVENTS_AS_OF, "last 90 minutes": "2024-01-30 12:00:00", "last 5 days": EVENTS_AS_OF, "last week": EVENTS_AS_OF,
        "last month": EVENTS_AS_OF, "this year": EVENTS_AS_OF, "today": "2024-01-30 12:00:00",
    }
    one = ev.agg(*[F.count_if(relative_time("ts", s, now)).alias(s) for s, now in asked.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("spec"), F.col(f"`{s}`").alias("n")) for s in asked])))


@query("simple_predicate", with_views("dirty_events") + """
SELECT event_id, 'null' AS op FROM dirty_events WHERE value IS NULL UNION ALL SELECT event_id, 'not null' FROM dirty_events WHERE user_id IS NOT NULL
UNION ALL SELECT event_id, '>' FROM dirty_events WHERE value > 30 UNION ALL SELECT event_id, '<' FROM dirty_events WHERE value < 2""")
def _(spark, sf):
    from tidemark.functions.scalar import simple_predicate

    df = view(spark, sf, "dirty_events")
    wanted = [("value", "null", None), ("user_id", "not null", None), ("value", ">", 30), ("value", "<", 2)]
    found = [df.where(simple_predicate(c, op, v)).select("event_id", F.lit(op).alias("op")) for c, op, v in wanted]
    return H.union_assets(*found)


@query("select_count", "SELECT count(*) AS total FROM lineitem")
def _(spark, sf):
    return H.select_or_count(view(spark, sf, "lineitem"))


@query("select_newest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    return H.select_or_count(view(spark, sf, "orders"), ["o_orderkey", "o_orderdate"], "o_orderdate", limit=100)


@query("capped_result", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 200")
def _(spark, sf):
    grouped = H.group_count(view(spark, sf, "events"), ["event_type", "user_id"])
    return H.capped(grouped.orderBy(F.col("n").desc(), "event_type", "user_id"), 200)


@query("distinct_top_values", """
SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""")
def _(spark, sf):
    ev = view(spark, sf, "events").select("event_type", "user_id", "event_id", "ts")
    return H.first_per_key(ev, ["event_type", "user_id"], ["ts", "event_id"])


@query("snapshot_agg", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS n_snapshots FROM events GROUP BY 1")
def _(spark, sf):
    return H.snapshot_span(view(spark, sf, "events"), "ts", ["user_id"])
