"""Upserts and appends as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(
    old: DataFrame, new: DataFrame, keys: list[str], order: list[str], old_unique: bool = False, parts: int | None = None
) -> DataFrame:
    """Old and new rows with the latest per key; a new row wins over an equally old one.

    ``max_by`` combines before the shuffle, so many versions of one key meet
    as one row per task.

    ``old_unique=True`` states that ``old`` holds each (non-null) key once, as a table
    kept by this function does. Then only old rows whose key is in ``new`` are
    compared, the rest pass through an anti join, which does not shuffle the table
    when the new keys are few enough for Catalyst to broadcast.

    ``parts`` deals the rows by key to so many tasks before they are compared. It is for keys of few versions,
    where combining first saves nothing and a task would sort its whole input.
    """
    if old_unique:
        touched = new.select(*keys).distinct()
        merged = upsert_latest(old.join(touched, keys, "left_semi").select(*old.columns), new, keys, order, parts=parts)
        return old.join(touched, keys, "left_anti").select(*old.columns).unionByName(merged)
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    if parts is not None:
        both = both.repartition(parts, *keys)
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in old.columns])
