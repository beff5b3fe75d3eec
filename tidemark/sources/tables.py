"""Table reads, partitioned writes, copies, refreshes and maintenance facts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import as_ts
from tidemark.operators.shaping import topk


def scan_table(spark: SparkSession, name: str, cols: list[str] | None = None, schema=None) -> DataFrame:
    """A path (with a slash) or catalog table, only the named columns."""
    if "/" in name:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(name)
    else:
        df = spark.table(name)
    return df.select(*cols) if cols else df


def write_partitioned(
    df: DataFrame, path: str, by: dict[str, Column] | list[str], mode: str = "overwrite", rebalance: bool = True
) -> None:
    """Snappy Parquet partitioned by columns or derived columns, e.g. ``{'day': to_date('ts')}``.

    Rows are rebalanced on the partition columns: small partitions become one file
    each, while a hot partition (one day with a third of the rows) is split over
    several tasks by AQE and not sent to one. Input already clustered by the
    partition columns needs no shuffle: pass ``rebalance=False``.
    """
    made = by if isinstance(by, dict) else {}
    names = list(by)
    out = df.withColumns(made) if made else df
    known = [n for n in names if n in out.columns]  # an absent identity column does not partition
    writer = (out.hint("rebalance", *known) if known and rebalance else out).write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*known) if known else writer).parquet(path)


def refresh_partition(df: DataFrame, path: str, by: list[str], replaced: list[dict] | None = None) -> None:
    """Replace the partitions present in ``df``; a rerun changes nothing.

    ``replaced`` names the recomputed partitions, as column to value: those of them for
    which ``df`` has no row are removed, so a day that became empty does not stay.
    """
    spark = df.sparkSession
    for partition in replaced or []:
        if df.where(functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in partition.items()])).isEmpty():
            old = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{c}={partition[c]}" for c in by)]))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*by)
        .parquet(path)
    )


def project_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The sink's columns in its order and types; unknown ones dropped, missing ones null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


_SOURCES = ("topic", "table")
_SINKS = ("table", "directory", "warehouse")


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """``{'type': 'topic'|'table', ...}`` as a batch frame."""
    kind = source.get("type")
    if kind == "topic":
        return (
            spark.read.format("kafka")
            .option("kafka.bootstrap.servers", source["servers"])
            .option("subscribe", source["name"])
            .option("startingOffsets", source.get("from", "earliest"))
            .load()
        )
    if kind == "table":
        return scan_table(spark, source["name"], source.get("columns"), source.get("schema"))
    raise ValueError(f"unknown source type '{kind}', expected one of {_SOURCES}")


def write_sink(df: DataFrame, sink: dict) -> None:
    """``{'type': 'table'|'directory'|'warehouse', ...}``; columns the sink does not
    know are dropped when it states a schema."""
    kind = sink.get("type")
    if kind not in _SINKS:
        raise ValueError(f"unknown sink type '{kind}', expected one of {_SINKS}")
    if sink.get("schema") is not None:
        df = project_to_schema(df, sink["schema"])
    mode = sink.get("mode", "append")
    if kind == "table":
        writer = df.write.mode(mode)
        if sink.get("bucket"):  # (number, columns): tables bucketed alike join without a shuffle
            number, cols = sink["bucket"]
            writer = writer.bucketBy(number, *cols).sortBy(*cols)
        writer.saveAsTable(sink["name"])
    elif kind == "directory":
        write_partitioned(df, sink["path"], sink.get("by", []), mode)
    else:
        options = {"url": sink["url"], "dbtable": sink["name"], **sink.get("options", {})}
        df.write.format("jdbc").options(**options).mode(mode).save()


def copy(spark: SparkSession, source: dict, sink: dict) -> None:
    """Copy a source to a sink; both types are checked before anything is read."""
    if sink.get("type") not in _SINKS:
        raise ValueError(f"unknown sink type '{sink.get('type')}', expected one of {_SINKS}")
    write_sink(read_source(spark, source), sink)


def convert_format(spark: SparkSession, src: str, fmt: str, dst: str, schema=None) -> None:
    """JSON, CSV, ORC or Avro records to snappy Parquet. A stated schema saves the
    inference pass over the data."""
    if fmt not in ("json", "csv", "orc", "avro", "parquet"):
        raise ValueError(f"unsupported format '{fmt}'")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    reader.load(src).write.mode("overwrite").option("compression", "snappy").parquet(dst)


def judge_json(df: DataFrame, body: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """Adds the parsed struct ``_p`` and the ``reason`` a row is dead, null for good rows.

    A row is dead if the text does not parse or a required field is missing; the job
    does not stop on bad input. The struct goes through a one-element generator:
    filters on it are then not pushed below, where they would parse the text again.
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = df.select(
        "*",
        F.explode(
            F.array(F.from_json(F.col(body), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        ).alias("_p"),
    )
    missing = F.array_compact(
        F.array(F.lit(None).cast("string"), *[F.when(F.col(f"_p.{c}").isNull(), F.lit(c)) for c in (required or [])])
    )
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "unparsable")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(",", missing)))
    )
    return parsed.withColumn("reason", reason)


def split_bad(df: DataFrame, body: str, schema: T.StructType, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON text rows as (good rows with the parsed columns, dead letters with a reason).

    Two filters over :func:`judge_json`; a job that writes both sides reads its input
    twice unless it persists the batch, as the stream writer does.
    """
    judged = judge_json(df, body, schema, required)
    good = judged.where(F.col("reason").isNull()).select(
        *[c for c in df.columns if c != body], *[F.col(f"_p.{f.name}").alias(f.name) for f in schema]
    )
    return good, judged.where(F.col("reason").isNotNull()).select(*df.columns, "reason")


def incremental(df: DataFrame, ts: str, since, day: str | None = None) -> DataFrame:
    """Rows from ``since`` on; with a derived day column the same bound prunes partitions."""
    out = df.where(F.col(ts) >= as_ts(since))
    return out if day is None else out.where(F.col(day) >= F.to_date(as_ts(since)))


def append_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append results, scores or decisions: one job for all rows of a run."""
    writer = df.write.mode("append").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def listing_version(files: DataFrame, asset: str = "asset") -> DataFrame:
    """Data version per asset from its file listing (path, size, modification time).

    A sum of per-file hashes: independent of order, combined in every task.
    """
    one = F.xxhash64("path", "size", "modified")
    return files.groupBy(asset).agg(
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.bit_xor(one).cast("string")).alias("version")
    )


def changed_assets(listing: DataFrame, state: DataFrame, asset: str = "asset") -> DataFrame:
    """Assets to scan: those whose version differs from the last scanned one. A
    missing version always scans."""
    known = state.where(F.col("version").isNotNull()).select(asset, "version")
    return listing.join(known, [asset, "version"], "left_anti")


def topic_sample(messages: DataFrame, n: int = 2) -> DataFrame:
    """First n messages of every topic over all its partitions."""
    return topk(messages, ["topic"], [F.col("partition"), F.col("offset")], n)


def object_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below the root; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def table_stats(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a file-backed frame. Only file metadata columns are
    needed, so the scan decodes no data."""
    per_file = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).groupBy("path", "size").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )


def table_history(snapshots: DataFrame, cutoff=None) -> DataFrame:
    """Creation, last change and number of snapshots per table; tables created since
    the cutoff only."""
    out = snapshots.groupBy("table_name").agg(
        F.min("committed_at").alias("created_at"), F.max("committed_at").alias("changed_at"),
        F.count(F.lit(1)).alias("n_snapshots"),
    )
    return out if cutoff is None else out.where(F.col("created_at") >= as_ts(cutoff))
