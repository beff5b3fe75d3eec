"""Streaming queries: each reads its table as a file stream, runs to the end of the
available input and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_ms_time
from tidemark.operators import kpi as K
from tidemark.operators.shaping import latest_per_key
from tidemark.plans.registry import as_bigint, query
from tidemark.plans.sources import DEAD_SQL, MESSAGE_SCHEMA
from tidemark.plans.views import EVENTS_AS_OF, SCHEMAS, view, with_views
from tidemark.session import scratch_path
from tidemark.sources import avro as A
from tidemark.sources.tables import split_bad
from tidemark.streaming import jobs as J


def stream(spark, sf, name):
    """A table as a file stream; the pattern fits a single file and a folder."""
    return J.stream_files(spark, f"{sf}/{name}.parquet*", SCHEMAS[name])


def landed(spark, df, label, by=None):
    path = scratch_path(spark, label)
    J.land_stream(df, path, scratch_path(spark, label + "-cp"), by, available_now=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def updated(spark, df, label, keys):
    """Run an aggregate in update mode and take each key's latest row."""
    path = scratch_path(spark, label)
    J.land_updates(df, path, scratch_path(spark, label + "-cp")).awaitTermination()
    return latest_per_key(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def order_stream(spark, sf):
    """Order events as they arrive: the line items stream, their orders are static."""
    return view(spark, sf, "order_events", lineitem=stream(spark, sf, "lineitem"))


LANDED_SQL = with_views("order_events") + """
SELECT order_id, customer_id, quantity, unit_price, coalesce(discount_pct, 0) AS discount_pct, kafka_partition, kafka_offset,
  last_day(CAST(make_timestamp(event_timestamp * 1000) AS DATE)) AS ingest_date FROM order_events
WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0"""
LANDED_COLS = [
    "order_id", "customer_id", "quantity", "unit_price", "discount_pct", "kafka_partition", "kafka_offset", "ingest_date",
]


def landing(spark, sf):
    at = F.last_day(F.to_date(epoch_ms_time("event_timestamp"))).cast("timestamp")
    return J.landing_projection(order_stream(spark, sf), at)


@query("stream_landing", LANDED_SQL)
def _(spark, sf):
    return landed(spark, landing(spark, sf), "raw-orders", ["ingest_date"]).select(*LANDED_COLS)


@query("stream_land_raw", LANDED_SQL)
def _(spark, sf):
    return landed(spark, landing(spark, sf).select(*LANDED_COLS), "raw-orders-flat").select(*LANDED_COLS)


@query("continuous_copy", "SELECT event_id, user_id, value, CAST(NULL AS VARCHAR) AS note FROM events")
def _(spark, sf):
    from pyspark.sql import types as T

    sink = T.StructType.fromDDL("event_id bigint, user_id bigint, value double, note string")
    path = scratch_path(spark, "copied")
    J.continuous_copy(
        stream(spark, sf, "events"), {"type": "directory", "path": path, "schema": sink},
        scratch_path(spark, "copied-cp"), available_now=True,
    ).awaitTermination()
    return spark.read.schema(sink).parquet(path)


@query("watermark", "SELECT event_id, ts, user_id FROM events")
def _(spark, sf):
    # no stateful step follows the watermark, so no late row is dropped
    late = stream(spark, sf, "events").withWatermark("ts", "10 seconds").select("event_id", "ts", "user_id")
    return landed(spark, late, "watermarked")


@query("stream_framed_messages", "SELECT event_id, 1 + event_id % 70000 AS schema_id, props AS payload FROM events")
def _(spark, sf):
    framed = A.frame(F.lit(1) + F.col("event_id") % 70000, F.col("props"))
    good, _ = A.split_frames(stream(spark, sf, "events").select("event_id", framed.alias("value")), "value")
    return landed(spark, good.withColumn("payload", F.col("payload").cast("string")), "framed")


@query("stream_kafka_avro", """
SELECT user_id, event_type, value, CAST(event_id % 4 AS INT) AS kafka_partition, event_id AS kafka_offset, ts AS event_time FROM events""")
def _(spark, sf):
    # the topic's message columns from a file stream; JSON stands in for the Avro payload,
    # whose connector is not part of the test image
    body = F.to_json(F.struct("user_id", "event_type", "value"))
    raw = stream(spark, sf, "events").select(
        A.frame(F.lit(7), body).alias("value"), (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
    )
    records = J.decode_topic(raw, lambda payload: F.from_json(payload.cast("string"), MESSAGE_SCHEMA))
    return landed(spark, records, "decoded")


@query("stream_dead_letters", with_views("dirty_events") + DEAD_SQL)
def _(spark, sf):
    body = F.to_json(F.struct("user_id", "event_type", "value"))
    source = view(spark, sf, "dirty_events", events=stream(spark, sf, "events")).select(
        "event_id", F.when(F.col("value") > 55, F.concat(F.lit("oops "), body)).otherwise(body).alias("body")
    )
    good, dead = scratch_path(spark, "good"), scratch_path(spark, "dead")
    J.land_with_dead_letters(
        source, lambda b: split_bad(b, "body", MESSAGE_SCHEMA, ["user_id", "event_type"]), good, dead,
        scratch_path(spark, "dead-cp"),
    ).awaitTermination()
    lost = spark.read.parquet(dead).select("event_id", F.lit("dead").alias("sink"), "reason")
    kept = spark.read.parquet(good).select("event_id", F.lit("good").alias("sink"), F.lit(None).cast("string").alias("reason"))
    return lost.unionByName(kept)


def dirty_stream(spark, sf):
    return view(spark, sf, "dirty_events", events=stream(spark, sf, "events"))


@query("stream_schema_validation", with_views("dirty_events") + """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS total,
  count(*) FILTER (WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL) AS complete,
  floor(100.0::DOUBLE * count(*) FILTER (WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL) / count(*) * 100 + 0.5) / 100
    AS complete_pct, max(ts) AS latest_event FROM dirty_events GROUP BY 1""")
def _(spark, sf):
    checked = J.schema_validation(dirty_stream(spark, sf), "ts", ["user_id", "event_type", "value"])
    return updated(spark, checked, "validated", ["window_start"])


@query("stream_null_check", with_views("dirty_events") + "\nUNION ALL\n".join(f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, '{c}' AS "column", count(*) AS total, count({c}) AS non_null,
  floor(100.0::DOUBLE * (count(*) - count({c})) / count(*) * 100 + 0.5) / 100 AS null_pct FROM dirty_events GROUP BY 1""" for c in ("user_id", "value")))
def _(spark, sf):
    checked = J.null_check(dirty_stream(spark, sf), "ts", ["user_id", "value"])
    return updated(spark, checked, "nulls", ["window_start", "column"])


@query("stream_freshness", f"""
SELECT user_id, max(ts) AS last_event, floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 3600000000.0::DOUBLE * 10000 + 0.5) / 10000 AS age_hours,
  CASE WHEN age_hours <= 1 THEN 'pass' WHEN age_hours <= 5 THEN 'warn' ELSE 'fail' END AS status FROM events GROUP BY user_id""")
def _(spark, sf):
    return J.freshness(view(spark, sf, "events"), "ts", EVENTS_AS_OF, ["user_id"])


@query("stream_freshness_live", """
WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' AS w FROM events),
e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), w) AS after, w
      FROM (SELECT DISTINCT user_id, ts FROM events) x, w WHERE ts < w)
SELECT user_id, ts AS at, 'pass' AS status FROM e WHERE before IS NULL OR ts > before + INTERVAL '1 hour'
UNION ALL SELECT user_id, ts + INTERVAL '1 hour', 'warn' FROM e WHERE ts + INTERVAL '1 hour' < after
UNION ALL SELECT user_id, ts + INTERVAL '5 hours', 'fail' FROM e WHERE ts + INTERVAL '5 hours' < after""")
def _(spark, sf):
    """The events in three arrivals, the stream started anew from its checkpoint for each."""
    events = view(spark, sf, "events").select("user_id", "ts")
    at = F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    third = F.least(F.floor((at - low) * 3 / max(high - low, 1)), F.lit(2))
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "status", "status-cp"))
    for i in range(4):  # the last start has no events, only the moved watermark
        if i < 3:
            events.where(third == i).write.mode("append").parquet(folder)
        arrived = spark.readStream.schema(events.schema).parquet(folder)
        J.live_status(arrived, "ts", "user_id").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, at timestamp, status string").parquet(out)


@query("stream_dedup", with_views("order_events") + "SELECT DISTINCT kafka_partition, kafka_offset FROM order_events")
def _(spark, sf):
    timed = order_stream(spark, sf).withColumn("event_time", epoch_ms_time("event_timestamp")).select(
        "kafka_partition", "kafka_offset", "event_time"
    )
    keys = ["kafka_partition", "kafka_offset"]
    return landed(spark, J.dedup(timed, "event_time", keys), "deduped").select(*keys)


@query("stream_daily_amount", """
SELECT CAST(ts AS DATE) AS day, user_id, event_type, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS amount, count(*) AS n
FROM events GROUP BY ALL""")
def _(spark, sf):
    sums = J.daily_amount(stream(spark, sf, "events"), "ts", ["user_id", "event_type"], "value")
    return updated(spark, sums, "daily", ["day", "user_id", "event_type"])


@query("stream_counter_15min", as_bigint(with_views("counters") + """
SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, carrier, counter, sum(value) AS total, avg(value) AS mean,
  max(value) AS highest, min(value) AS lowest FROM counters GROUP BY 1, 2, 3""", "total"))
def _(spark, sf):
    source = view(spark, sf, "counters", events=stream(spark, sf, "events")).withWatermark("ts", "1 minute")
    keys = ["window_start", "carrier", "counter"]
    return updated(spark, K.counter_windows(source, ["carrier", "counter"]), "counters", keys)
