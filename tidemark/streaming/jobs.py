"""Structured Streaming jobs: topic source, landing, copies, windowed checks.

Transforms take and return frames and also run on batch input; only
``land_stream`` and ``continuous_copy`` start a query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalar import as_ts, half_up
from tidemark.operators.orders import boundary_filter
from tidemark.sources.avro import split_frames
from tidemark.sources.tables import project_to_schema


def stream_kafka_avro(
    spark: SparkSession, servers: str, topic: str, avro_schema: str, delay: str = "10 seconds", start: str = "earliest",
    per_batch: int | None = None,
) -> DataFrame:
    """Framed Avro messages of a topic with partition, offset and event time.

    Needs the Kafka and Avro connectors on the cluster's class path.
    """
    from pyspark.sql.avro.functions import from_avro

    raw = kafka_stream(spark, servers, topic, start, per_batch)
    return decode_topic(raw, lambda payload: from_avro(payload, avro_schema), delay)


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "earliest", per_batch: int | None = None) -> DataFrame:
    """Raw committed messages of a topic; a backlog is taken in batches of ``per_batch`` messages at most, if it is given."""
    limit = {} if per_batch is None else {"maxOffsetsPerTrigger": str(per_batch)}
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("kafka.isolation.level", "read_committed")
        .options(**limit)
        .load()
    )


def decode_topic(raw: DataFrame, decode, delay: str | None = "10 seconds") -> DataFrame:
    """(value, partition, offset, timestamp) messages to records with their position
    and event time. ``decode`` turns the unframed payload into a struct; badly framed
    messages are left to the dead-letter path."""
    good, _ = split_frames(raw.select("value", "partition", "offset", F.col("timestamp").alias("event_time")), "value")
    records = good.withColumn("r", decode(F.col("payload"))).select(
        "r.*", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "event_time"
    )
    return records.withWatermark("event_time", delay) if delay else records


def stream_files(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """A folder (or pattern) of Parquet files as a stream of the stated schema; a backlog is taken in batches
    of ``per_batch`` files at most, if it is given."""
    limit = {} if per_batch is None else {"maxFilesPerTrigger": str(per_batch)}
    return spark.readStream.schema(schema).options(**limit).parquet(path)


def landing_projection(events: DataFrame, ingested_at=None) -> DataFrame:
    """Well-formed events with a default discount and the landing time."""
    at = F.current_timestamp() if ingested_at is None else ingested_at
    return boundary_filter(events).withColumns(
        {"discount_pct": F.coalesce(F.col("discount_pct"), F.lit(0.0)), "ingested_at": at, "ingest_date": F.to_date(at)}
    )


def _clustered(df: DataFrame, by: list[str], files: int) -> DataFrame:
    """Rows of one partition value in ``files`` tasks at most, so a batch adds no more files than that to it.

    A hash of the row chooses the task, so a hot value is split and a retried task deals alike."""
    plain = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(files))
    return df.repartition(*by, salt)


def land_stream(
    df: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, available_now: bool = False, every: str = "1 minute",
    files: int = 4,
) -> StreamingQuery:
    """Append-only landing to partitioned Parquet, exactly once by the checkpoint; a batch adds ``files`` files at most to a partition."""
    writer = (
        (_clustered(df, by, files) if by else df).writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).option("compression", "snappy")
    )
    if by:
        writer = writer.partitionBy(*by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def continuous_copy(
    df: DataFrame, sink: dict, checkpoint: str, available_now: bool = False, every: str = "1 minute"
) -> StreamingQuery:
    """Stream any source to a lakehouse sink, batch by batch.

    ``directory`` lands files; ``table`` appends to a catalog table. Columns the
    sink does not know are dropped when it states a schema.
    """
    kind = sink.get("type")
    if kind not in ("directory", "table"):
        raise ValueError(f"unknown stream sink '{kind}'")
    if sink.get("schema") is not None:
        df = project_to_schema(df, sink["schema"])
    if kind == "directory":
        return land_stream(df, sink["path"], checkpoint, sink.get("by"), available_now, every, sink.get("files", 4))
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.toTable(sink["name"])


def land_with_dead_letters(df: DataFrame, split, good_path: str, dead_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Two sinks from one stream: ``split(batch)`` gives (good, dead), each appended.

    The batch id is a partition of both sinks and is overwritten on a retry, so a
    repeated batch does not double its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for part, path in zip(split(kept), (good_path, dead_path)):
                (
                    part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
                )
        finally:
            kept.unpersist()

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def schema_validation(df: DataFrame, ts: str, cols: list[str], width: str = "1 day", delay: str | None = "10 seconds") -> DataFrame:
    """Per event-time window: rows, rows with all columns present, share and latest event."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    source = df.withWatermark(ts, delay) if delay else df
    total, complete = F.count(F.lit(1)), F.count_if(whole)
    return (
        source.groupBy(F.window(ts, width).alias("w"))
        .agg(total.alias("total"), complete.alias("complete"), F.max(ts).alias("latest_event"))
        .select(
            F.col("w.start").alias("window_start"), "total", "complete",
            half_up(F.lit(100.0) * F.col("complete") / F.col("total"), 2).alias("complete_pct"), "latest_event",
        )
    )


def null_check(df: DataFrame, ts: str, cols: list[str], width: str = "1 hour", delay: str | None = "10 seconds") -> DataFrame:
    """Per window and column: total, non-null and null share, from one aggregate."""
    source = df.withWatermark(ts, delay) if delay else df
    counted = source.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"nn_{i}") for i, c in enumerate(cols)]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"nn_{i}").alias("non_null")) for i, c in enumerate(cols)]
    return counted.select(F.col("w.start").alias("window_start"), "total", F.inline(F.array(*rows))).select(
        "window_start", "column", "total", "non_null",
        half_up(F.lit(100.0) * (F.col("total") - F.col("non_null")) / F.col("total"), 2).alias("null_pct"),
    )


def freshness(df: DataFrame, ts: str, as_of, by: list[str] | None = None, warn_hours: float = 1.0, fail_hours: float = 5.0) -> DataFrame:
    """Hours since the last event: pass up to an hour, warn up to five, else fail."""
    age = (F.unix_micros(as_ts(as_of)) - F.unix_micros(F.col("last_event"))) / F.lit(3_600_000_000.0)
    out = df.groupBy(*(by or [])).agg(F.max(ts).alias("last_event")).withColumn("age_hours", half_up(age, 4))
    return out.withColumn(
        "status",
        F.when(F.col("age_hours") <= warn_hours, "pass").when(F.col("age_hours") <= fail_hours, "warn").otherwise("fail"),
    )


LIVE_STATE = "last long, status string, waiting array<long>"


def thinned(times: list[int], warn: int) -> list[int]:
    """Sorted event times without those whose neighbours are ``warn`` apart at most: they part no two silences."""
    out: list[int] = []
    for t in times:
        while len(out) > 1 and t - out[-2] <= warn:
            out.pop()
        if not out or t > out[-1]:
            out.append(t)
    return out


def live_status(df: DataFrame, ts: str, by: str, warn_hours: float = 1.0, fail_hours: float = 5.0, delay: str = "10 minutes") -> DataFrame:
    """(key, at, status) whenever a key's status changes: pass at an event, warn and fail when it has been silent so long.

    State is kept for each key, with one event-time timer for what comes next, so a key that falls silent changes its status without an
    event, once the watermark (the latest event less ``delay``) has passed the moment. Events that arrive out of order wait in the state
    until the watermark has passed them; those without which no silence would look longer are not kept, so few wait
    however many arrive. Null keys and times are left out.
    """
    warn, fail = (int(h * 3_600_000_000) for h in (warn_hours, fail_hours))
    key_type = df.schema[by].dataType.simpleString()

    def step(key, batches, state):
        last, status, waiting = state.get if state.exists else (None, None, [])
        waiting = [*waiting, *(t for b in batches for t in b["t"].tolist())]
        now = state.getCurrentWatermarkMs() * 1000
        waiting = thinned(sorted(waiting), warn)
        out = []

        def silence(until: int) -> None:
            nonlocal status
            for name, after, before in (("warn", warn, ("pass",)), ("fail", fail, ("pass", "warn"))):
                if last is not None and status in before and last + after < until:
                    status = name
                    out.append((last + after, name))

        for t in [t for t in waiting if t < now]:
            silence(t)
            if status != "pass":
                status = "pass"
                out.append((t, "pass"))
            last = t
        waiting = [t for t in waiting if t >= now]
        silence(now)
        state.update((last, status, waiting))
        # the next moment at which something may change by time alone
        moments = waiting[:1]
        if last is not None and status in ("pass", "warn"):
            moments.append(last + (warn if status == "pass" else fail))
        if moments:
            state.setTimeoutTimestamp(max(min(moments) // 1000 + 1, now // 1000 + 1))
        yield pd.DataFrame({by: [key[0]] * len(out), "at": [t for t, _ in out], "status": [n for _, n in out]})

    rows = df.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay).select(by, ts, F.unix_micros(ts).alias("t"))
    changes = rows.groupBy(by).applyInPandasWithState(step, f"`{by}` {key_type}, at long, status string", LIVE_STATE, "append", "EventTimeTimeout")
    return changes.withColumn("at", F.timestamp_micros("at"))


def dedup(df: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """One event per key within the watermark, state expiring with it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_amount(df: DataFrame, ts: str, by: list[str], amount: str, delay: str | None = "60 seconds") -> DataFrame:
    """Amount per day and key. Grouped by an event-time window, so state expires."""
    source = df.withWatermark(ts, delay) if delay else df
    return (
        source.groupBy(F.window(ts, "1 day").alias("w"), *by)
        .agg(F.sum(F.col(amount).cast("decimal(20,6)")).cast("double").alias("amount"), F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), *by, "amount", "n")
    )


def land_updates(df: DataFrame, path: str, checkpoint: str, order: str = "batch_id") -> StreamingQuery:
    """Run a windowed aggregate in update mode: every batch writes its changed rows
    under the batch number, readers take the latest per key (``latest_per_key``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(order, F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(order).parquet(path)
        )

    return (
        df.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

