"""Queries of reads, sinks and table maintenance; sinks are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import as_ts
from tidemark.operators.quality import scorecard as K
from tidemark.operators.sinks import upsert_latest
from tidemark.plans.quality import ORDER_CARD, order_card, sql_round
from tidemark.plans.registry import query
from tidemark.plans.views import AS_OF, SCHEMAS, view, with_views
from tidemark.session import scratch_path
from tidemark.sources import tables as S


@query("scan_table", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def _(spark, sf):
    return S.scan_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"], SCHEMAS["lineitem"])


@query("write_partitioned", """
SELECT event_id, user_id, value, event_type, CAST(ts AS DATE) AS day FROM events""")
def _(spark, sf):
    path = scratch_path(spark, "events-by-day")
    S.write_partitioned(view(spark, sf, "events"), path, {"day": F.to_date("ts"), "event_type": F.col("event_type")})
    return spark.read.parquet(path).select("event_id", "user_id", "value", "event_type", "day")


@query("copy_source_to_sink", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "orders-copy")
    sink = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string")
    S.copy(
        spark,
        {"type": "table", "name": f"{sf}/orders.parquet", "schema": SCHEMAS["orders"]},
        {"type": "directory", "path": path, "by": ["o_orderstatus"], "schema": sink},
    )
    return spark.read.parquet(path)


@query("project_to_sink_schema", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(NULL AS DATE) AS listed_on, CAST(p_size AS BIGINT) AS p_size FROM part""")
def _(spark, sf):
    sink = T.StructType.fromDDL("p_partkey string, p_name string, listed_on date, p_size bigint")
    return S.project_to_schema(view(spark, sf, "part"), sink)


@query("convert_format", "SELECT * FROM part")
def _(spark, sf):
    raw, out = scratch_path(spark, "part-json"), scratch_path(spark, "part-parquet")
    view(spark, sf, "part").write.json(raw)
    S.convert_format(spark, raw, "json", out, SCHEMAS["part"])
    return spark.read.schema(SCHEMAS["part"]).parquet(out)


def messages(spark, sf):
    """JSON message per event: some broken, some without user or type."""
    body = F.to_json(F.struct("user_id", "event_type", "value"))
    return view(spark, sf, "dirty_events").select(
        "event_id", F.when(F.col("value") > 55, F.concat(F.lit("oops "), body)).otherwise(body).alias("body")
    )


MESSAGE_SCHEMA = (
    T.StructType().add("user_id", T.LongType()).add("event_type", T.StringType()).add("value", T.DoubleType())
)
DEAD_SQL = """
SELECT event_id, 'dead' AS sink, CASE WHEN value > 55 THEN 'unparsable' ELSE 'missing ' || concat_ws(',',
  CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN event_type IS NULL THEN 'event_type' END) END AS reason
FROM dirty_events WHERE coalesce(value, 0) > 55 OR user_id IS NULL OR event_type IS NULL
UNION ALL SELECT event_id, 'good', NULL FROM dirty_events
WHERE coalesce(value, 0) <= 55 AND user_id IS NOT NULL AND event_type IS NOT NULL"""


@query("dead_letter_split", with_views("dirty_events") + DEAD_SQL)
def _(spark, sf):
    judged = S.judge_json(messages(spark, sf), "body", MESSAGE_SCHEMA, ["user_id", "event_type"])
    path = scratch_path(spark, "messages")
    sink = F.when(F.col("reason").isNull(), "good").otherwise("dead")
    S.write_partitioned(judged.select("event_id", "_p.*", "reason"), path, {"sink": sink}, rebalance=False)
    return spark.read.parquet(path).select("event_id", "sink", "reason")


@query("append_check_results", ORDER_CARD + """
SELECT 'run-1' AS run_id, 'order_events' AS table_name, CASE WHEN "check" = 'validity' THEN rule ELSE "check" END AS check_name,
  "column" AS column_name, """ + sql_round("(1 - metric_value) * 100", 2) + """ AS metric_value, label AS metric_label, status FROM card
UNION ALL SELECT 'run-2', 'order_events', CASE WHEN "check" = 'validity' THEN rule ELSE "check" END,
  "column", """ + sql_round("(1 - metric_value) * 100", 2) + """, label, status FROM card""")
def _(spark, sf):
    path = scratch_path(spark, "check-results")
    card = order_card(spark, sf)
    for run in ("run-1", "run-2"):
        S.append_rows(K.result_rows(card, run, AS_OF), path)
    return spark.read.parquet(path).select(
        "run_id", "table_name", "check_name", "column_name", "metric_value", "metric_label", "status"
    )


@query("append_score_rollup", ORDER_CARD + "SELECT asset, TIMESTAMP '" + AS_OF + "' AS ts, " + sql_round(
    "avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END::DOUBLE) * 100", 1) + """ AS score,
  count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM card GROUP BY asset""")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    score = K.overall_score(order_card(spark, sf), ["asset"]).withColumn("ts", as_ts(AS_OF))
    S.append_rows(score, path)
    return spark.read.parquet(path).select("asset", "ts", "score", "n_pass", "n_fail")


@query("upsert_latest", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CLOSED' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS indexed_at FROM orders
UNION ALL SELECT -1 - o_orderkey, 'NEW', 2 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    o = view(spark, sf, "orders")
    old = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("indexed_at"))
    changed = o.where(F.col("o_orderstatus") == "P").select("o_orderkey", F.lit("CLOSED").alias("status"), F.lit(2).alias("indexed_at"))
    added = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        (F.lit(-1) - F.col("o_orderkey")).alias("o_orderkey"), F.lit("NEW").alias("status"), F.lit(2).alias("indexed_at")
    )
    return upsert_latest(old, changed.unionByName(added), ["o_orderkey"], ["indexed_at"])


@query("refresh_partition", """
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN value * 2 ELSE value END AS value FROM events""")
def _(spark, sf):
    path = scratch_path(spark, "events-by-type")
    ev = view(spark, sf, "events").select("event_id", "event_type", "value")
    S.write_partitioned(ev, path, ["event_type"])
    again = ev.where(F.col("event_type") == "view").withColumn("value", F.col("value") * 2)
    for _run in range(2):  # a rerun must not change the result
        S.refresh_partition(again, path, ["event_type"])
    return spark.read.parquet(path).select("event_id", "event_type", "value")


@query("incremental_since", with_views("raw_orders") + """
SELECT order_id, ingested_at FROM raw_orders WHERE ingested_at >= TIMESTAMP '2001-06-01 00:00:00'""")
def _(spark, sf):
    raw = view(spark, sf, "raw_orders").withColumn("ingest_date", F.to_date("ingested_at"))
    return S.incremental(raw, "ingested_at", "2001-06-01 00:00:00", "ingest_date").select("order_id", "ingested_at")


@query("scan_if_changed", """
SELECT 'table_' || CAST(user_id AS VARCHAR) AS asset, count(*) AS n_files FROM events GROUP BY user_id
HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' OR min(value) < 0.05::DOUBLE""")
def _(spark, sf):
    files = view(spark, sf, "events").select(
        F.concat(F.lit("table_"), F.col("user_id").cast("string")).alias("asset"),
        F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), F.col("ts").alias("modified"), "value",
    )
    before = files.where(F.col("modified") < as_ts("2024-01-30 12:00:00"))
    lost = files.groupBy("asset").agg((F.min("value") < 0.05).alias("lost"))
    state = S.listing_version(before).join(lost, "asset").select(
        "asset", F.when(~F.col("lost"), F.col("version")).alias("version")
    )
    changed = S.changed_assets(S.listing_version(files), state)
    return files.join(changed, "asset", "left_semi").groupBy("asset").agg(F.count(F.lit(1)).alias("n_files"))


@query("topic_sample", with_views("progress") + """
SELECT topic, partition_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY partition_id, event_id) AS rn FROM progress)
WHERE rn <= 2""")
def _(spark, sf):
    m = view(spark, sf, "progress").select(
        "topic", F.col("partition_id").alias("partition"), F.col("event_id").alias("offset")
    )
    return S.topic_sample(m, 2).select("topic", F.col("partition").alias("partition_id"), F.col("offset").alias("event_id"))


@query("object_inventory")
def _(spark, sf):
    return S.object_inventory(spark, sf)


@query("table_stats")
def _(spark, sf):
    return S.table_stats(view(spark, sf, "lineitem"))


@query("table_history", with_views("scores") + """
SELECT asset AS table_name, min(ts) AS created_at, max(ts) AS changed_at, count(*) AS n_snapshots FROM scores GROUP BY 1
HAVING min(ts) >= TIMESTAMP '2024-01-01 06:00:00'""")
def _(spark, sf):
    snaps = view(spark, sf, "scores").select(F.col("asset").alias("table_name"), F.col("ts").alias("committed_at"))
    return S.table_history(snaps, "2024-01-01 06:00:00")


@query("decision_log", with_views("decisions") + "SELECT agent_id, decision_type, status, record_id, output FROM decisions")
def _(spark, sf):
    path = scratch_path(spark, "decisions")
    log = view(spark, sf, "decisions").select("agent_id", "decision_type", "status", "record_id", "output", "ts")
    S.write_partitioned(log, path, ["agent_id"], "append")
    return spark.read.parquet(path).select("agent_id", "decision_type", "status", "record_id", "output")


