"""General shaping: counts, top-k, first/latest per key, set operations, unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import as_ts, half_up


def conditional_counts(df: DataFrame, preds: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """All conditional counts (and the row count) in one aggregate."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(p).alias(name) for name, p in preds.items()]
    )


def group_count(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def status_counts(df: DataFrame, by: list[str], status: str, levels: list[str]) -> DataFrame:
    """One count column per status level and a total."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in levels]
    )


def having(df: DataFrame, by: list[str], aggs: dict[str, Column], keep: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]).where(keep)


def ordered_limit(df: DataFrame, order: list, n: int) -> DataFrame:
    """Top n by a total order; planned as a distributed top-n, not a full sort."""
    return df.orderBy(*order).limit(n)


def capped(df: DataFrame, cap: int) -> DataFrame:
    return df.limit(cap)


def topk(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows per key by a total order.

    The ``<= k`` filter lets Spark keep only k rows per key in every task before
    the shuffle, so a hot key does not move whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def latest_per_key(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Last record per key by ``order``, null orders counting as lowest.

    ``max_by`` combines before the shuffle: one row per key and task moves. ``parts`` deals the rows by key to
    so many tasks first, for keys of few records, where combining saves nothing and a task would sort its whole input.
    """
    if parts is not None:
        df = df.repartition(parts, *key)
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First record per key by ``order``."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_last(df: DataFrame, key: list[str], ts: list[str], value: str, digits: int = 1) -> DataFrame:
    """First and last value per key and their rounded difference."""
    order = F.struct(*ts)
    return (
        df.groupBy(*key)
        .agg(
            F.min_by(value, order).alias("first_value"),
            F.max_by(value, order).alias("last_value"),
            F.count(F.lit(1)).alias("runs"),
        )
        .withColumn("delta", half_up(F.col("last_value") - F.col("first_value"), digits))
    )


def recent(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows of the last ``days`` days, the bound being a literal the scan can use."""
    now = as_ts(as_of)
    return df.where((F.col(ts) >= now - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= now))


def latest_run(results: DataFrame, table: str = "table_name", run: str = "run_id", ts: str = "run_timestamp") -> DataFrame:
    """All rows of each table's latest run."""
    newest = results.groupBy(table).agg(F.max_by(run, F.struct(ts, run)).alias(run))
    return results.join(newest, [table, run], "left_semi")


def snapshot_span(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).alias("n_snapshots")
    )


def select_or_count(df: DataFrame, cols: list[str] | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Row count without ``cols``; else the columns, newest first; all rows unless a ``limit`` is given."""
    if not cols:
        return df.agg(F.count(F.lit(1)).alias("total"))
    out = df.select(*cols)
    if order:
        out = out.orderBy(F.col(order).desc(), *cols)
    return out if limit is None else out.limit(limit)


def union_assets(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overlap(a, b) -> Column:
    return F.array_intersect(a, b)


def missing(required, present) -> Column:
    return F.array_except(required, present)


def unpivot_specs(row: DataFrame, specs: list[dict], metric: str = "alias") -> DataFrame:
    """One wide result row to one row per spec.

    The specs are literals of the plan (a bounded list), joined by position:
    each becomes a struct of its constants and the value found under its alias.
    """
    items = []
    for spec in specs:
        consts = [F.lit(v).alias(k) for k, v in spec.items() if k != metric]
        items.append(F.struct(*consts, F.col(spec[metric]).cast("double").alias("value")))
    return row.select(F.inline(F.array(*items)))
