"""Job health, diagnosis, decision log, retries, threshold monitor, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import as_ts, half_up
from tidemark.operators.shaping import latest_per_key, status_counts

MAX_ATTEMPTS = 3


def health_state(lag, errors) -> Column:
    """critical above 100,000 messages or 10 % errors, degraded above 50,000 or 5 %."""
    lag, errors = F.coalesce(F.col(lag), F.lit(0)), F.coalesce(F.col(errors), F.lit(0.0))
    return (
        F.when((lag > 100_000) | (errors > 0.1), "critical")
        .when((lag > 50_000) | (errors > 0.05), "degraded")
        .otherwise("healthy")
    )


def health(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("state", health_state("consumer_lag", "error_rate"))


def diagnose(metrics: DataFrame) -> DataFrame:
    """Root cause, confidence and suggested fix per sample."""

    def finding(cause: str, confidence: float, fix: str) -> Column:
        return F.struct(
            F.lit(cause).alias("root_cause"), F.lit(confidence).alias("confidence"), F.lit(fix).alias("suggested_fix")
        )

    found = (
        F.when(F.coalesce("consumer_lag", F.lit(0)) > 100_000, finding("consumer_lag_excessive", 0.95, "restart_consumers"))
        .when(F.coalesce("error_rate", F.lit(0.0)) > 0.1, finding("high_error_rate", 0.85, "scale_workers"))
        .otherwise(finding("unknown", 0.3, "escalate_to_ops"))
    )
    return metrics.withColumn("_d", found).select(*metrics.columns, "_d.*")


def heal_or_escalate(diagnosed: DataFrame) -> DataFrame:
    """The action a confident diagnosis calls for, else escalate. No side effects."""
    sure = F.col("confidence") > 0.7
    action = (
        F.when(sure & (F.col("suggested_fix") == "restart_consumers"), "restart_consumers")
        .when(sure & (F.col("suggested_fix") == "scale_workers"), "scale_workers")
        .otherwise("escalate")
    )
    return diagnosed.withColumns({"action": action, "scale_factor": F.when(action == "scale_workers", 1.5)})


def decision_stats(log: DataFrame) -> DataFrame:
    """Totals and outcomes per agent in one scan."""
    return status_counts(log, ["agent_id"], "status", ["success", "warn", "fail"])


def retry_schedule(tasks: DataFrame, as_of) -> DataFrame:
    """Next retry 2^attempt seconds after the last failure; ready, pending or exhausted."""
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pow(F.lit(2), F.col("attempt")).cast("int"))
    return tasks.withColumn(
        "next_retry", F.when(F.col("attempt") < MAX_ATTEMPTS, F.col("failed_at") + wait)
    ).withColumn(
        "state",
        F.when(F.col("attempt") >= MAX_ATTEMPTS, "exhausted")
        .when(F.col("next_retry") <= as_ts(as_of), "ready")
        .otherwise("pending"),
    )


# Source kind to advised route and target format.
ROUTES = {
    "kafka_topic": ("Kafka Connect", "Iceberg"),
    "iceberg_table": ("Flink SQL", "Iceberg"),
    "ozone_volume": ("NiFi", "Parquet"),
    "hdfs_path": ("Spark Streaming", "Iceberg"),
}


def ingest_advice(assets: DataFrame) -> DataFrame:
    """Advised route per source kind; an unknown kind gets the file-path advice."""

    def pick(i: int) -> Column:
        out = F.lit(ROUTES["hdfs_path"][i])
        for kind, route in ROUTES.items():
            out = F.when(F.col("asset_type") == kind, route[i]).otherwise(out)
        return out

    return assets.withColumns({"route": pick(0), "target_format": pick(1)})


def threshold_monitor(
    metrics: DataFrame, lag: int = 10_000, write_ms: float = 500.0, errors: float = 0.01, window: str = "5 minutes"
) -> DataFrame:
    """Per window: largest lag, 75th percentile of write time and mean error rate against limits.

    Rows are first combined per (window, write time), so a window's repeated times meet
    as one row each; the exact percentile holds the distinct write times of a window in memory.
    """
    combined = metrics.groupBy(F.window("ts", window)["start"].alias("window_start"), "write_ms").agg(
        F.count("write_ms").alias("n"),
        F.max("consumer_lag").alias("max_lag"),
        F.sum(F.col("error_rate").cast("decimal(20,6)")).alias("errors"),
        F.count("error_rate").alias("n_errors"),
    )
    return (
        combined.groupBy("window_start")
        .agg(
            F.max("max_lag").alias("max_lag"),
            F.try_divide(F.sum("errors").cast("double"), F.sum("n_errors")).alias("error_rate"),
            F.percentile("write_ms", 0.75, F.col("n")).alias("p75"),
        )
        .withColumn("p75_write_ms", half_up("p75", 6))
        .select(
            "window_start", "max_lag", "p75_write_ms", "error_rate",
            F.when(F.col("max_lag") > lag, "WARNING").otherwise("OK").alias("lag_status"),
            F.when(F.col("p75_write_ms") > write_ms, "WARNING").otherwise("OK").alias("write_status"),
            F.when(F.col("error_rate") > errors, "WARNING").otherwise("OK").alias("error_status"),
        )
    )


def consumer_lag(progress: DataFrame, limit: int = 10_000) -> DataFrame:
    """Lag per consumer group and topic from the latest offsets of every partition."""
    last = latest_per_key(progress, ["consumer_group", "topic", "partition_id"], ["ts", "event_id"])
    return (
        last.groupBy("consumer_group", "topic")
        .agg(
            F.sum(F.col("end_offset") - F.col("committed_offset")).alias("total_lag"),
            F.count(F.lit(1)).alias("partitions"),
        )
        .withColumn("state", F.when(F.col("total_lag") >= limit, "LAGGING").otherwise("OK"))
    )
