"""Score history: trend, badge, upstream root cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import half_up
from tidemark.operators.shaping import recent


def quality_trend(scores: DataFrame, as_of, days: int = 14, order: tuple = ("ts", "run_no")) -> DataFrame:
    """Baseline, current, direction and level per asset over a window of days.

    Aggregates only (min_by, max_by), so an asset with a long history is combined
    in every task before it moves.
    """
    at = F.struct(*order)
    named = F.col("driver") != ""
    delta = half_up(F.col("current") - F.col("baseline"), 1)
    return (
        recent(scores, "ts", days, as_of)
        .groupBy("asset")
        .agg(
            F.min_by("score", at).alias("baseline"),
            F.max_by("score", at).alias("current"),
            F.coalesce(F.max_by(F.when(named, F.col("driver")), F.when(named, at)), F.lit("")).alias("driver"),
            F.count(F.lit(1)).alias("runs"),
        )
        .withColumn("delta", delta)
        .withColumns(
            {
                "direction": F.when(F.abs("delta") < 2, "stable").when(F.col("delta") > 0, "up").otherwise("down"),
                "level": F.when(F.col("current") >= 90, "good").when(F.col("current") >= 75, "fair").otherwise("poor"),
            }
        )
    )


def latest_badge(assets: DataFrame, latest: DataFrame, key: str = "asset") -> DataFrame:
    """Every asset with its last scan, if it has one."""
    return assets.join(latest, key, "left")


def upstream_trends(edges: DataFrame, trends: DataFrame) -> DataFrame:
    """Direct upstream neighbours of every asset with their trend, each pair once."""
    pairs = edges.select(F.col("to_fqn").alias("asset"), F.col("from_fqn").alias("upstream")).distinct()
    t = trends.select(F.col("asset").alias("upstream"), "current", "delta", "direction")
    return pairs.join(t, "upstream")


def root_cause(edges: DataFrame, trends: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per asset the upstream tables whose score is falling; the first by name is
    the cause. ``only`` restricts to assets that failed or are falling themselves."""
    ups = upstream_trends(edges, trends).where(F.col("direction") == "down")
    if only is not None:
        ups = ups.join(only.select("asset"), "asset", "left_semi")
    return ups.groupBy("asset").agg(
        F.min("upstream").alias("cause"),
        F.min_by("delta", "upstream").alias("cause_delta"),
        F.count(F.lit(1)).alias("falling_upstreams"),
    )
