"""Lineage over an edge table (from_fqn, to_fqn, pipeline)."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import col_of
from tidemark.operators.sinks import upsert_latest
from tidemark.session import settle, shuffle_parts

# Services by their plain names, with the type of their entities; a deployment states its own names.
SERVICE_TYPES = {
    "kafka": "topic", "hive": "table", "nifi": "pipeline", "looker": "dashboard",
    "metabase": "dashboard", "superset": "dashboard", "dbt": "pipeline",
}


def edge_step(frontier: DataFrame, edges: DataFrame, upstream: bool) -> DataFrame:
    """Neighbours of the frontier, one hop up or down, each once."""
    at, to = ("to_fqn", "from_fqn") if upstream else ("from_fqn", "to_fqn")
    hop = edges.select(F.col(at).alias("node"), F.col(to).alias("next"))
    return hop.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()


def _walk(edges: DataFrame, root: DataFrame, seen: DataFrame, depth: int | None, upstream: bool) -> DataFrame:
    """Hop by hop from the root, without a ``depth`` until nothing new is met; ``seen`` nodes are neither reported nor passed through."""
    frontier = root
    for hop in count(1) if depth is None else range(1, depth + 1):
        fresh = edge_step(frontier, edges, upstream).join(seen.select("node"), "node", "left_anti")
        fresh = settle(fresh.withColumn("depth", F.lit(-hop if upstream else hop)), "hop")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen


def lineage(edges: DataFrame, root: str, up: int | None = 3, down: int | None = 3, stored: bool = False) -> DataFrame:
    """(node, depth): negative upstream, 0 the root, positive downstream.

    ``stored`` states that ``edges`` is a plain table; a derived frame is written
    once, as both walks read it at every hop.

    The upstream walk goes first and its depth wins. Every hop is a stored table,
    so the plan does not grow with the walk, a lost executor costs one hop, and
    Spark broadcasts a frontier by its measured size; visited nodes are anti-joined,
    so cycles end. ``None`` as a depth walks on until nothing new is met.
    """
    start = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    edges = edges.select("from_fqn", "to_fqn")
    if not stored:
        edges = settle(edges, "edges")
    seen = _walk(edges, start, start, up, upstream=True)
    return _walk(edges, start, seen, down, upstream=False)


def neighbours(walked: DataFrame) -> DataFrame:
    return walked.where(F.abs("depth") == 1)


def edges_within(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """Distinct edges whose both ends were visited."""
    nodes = walked.select("node")
    pairs = edges.select("from_fqn", "to_fqn").distinct()
    return pairs.join(nodes, pairs.from_fqn == nodes.node, "left_semi").join(
        nodes, pairs.to_fqn == nodes.node, "left_semi"
    )


def distinct_edges(up: DataFrame, down: DataFrame, nodes: DataFrame) -> DataFrame:
    """Union of both edge lists without doubles, both ends among the nodes."""
    return edges_within(up.select("from_fqn", "to_fqn").unionByName(down.select("from_fqn", "to_fqn")), nodes)


def entity_type(fqn, explicit=None, services: Mapping[str, str] = SERVICE_TYPES) -> Column:
    """Entity type by the name's whole first part, unless given; a service not among ``services`` holds tables."""
    prefix = F.substring_index(col_of(fqn), ".", 1)
    ladder = F.lit("table")
    for name, kind in services.items():
        ladder = F.when(prefix == name, kind).otherwise(ladder)
    return ladder if explicit is None else F.coalesce(F.nullif(col_of(explicit), F.lit("")), ladder)


def impact(
    edges: DataFrame, root: str, attributes: DataFrame, down: int | None = None, stored: bool = False,
    services: Mapping[str, str] = SERVICE_TYPES,
) -> DataFrame:
    """Everything downstream with its attributes; ``down`` stops after so many hops."""
    walked = lineage(edges, root, 0, down, stored).where(F.col("depth") > 0)
    return walked.join(attributes, "node", "left").withColumn("entity_type", entity_type("node", services=services))


def add_edges(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """One edge per built job added to the edge table; a rebuilt job replaces its edge."""
    parts = shuffle_parts(edges.sparkSession)  # an edge has few versions
    cols = ["from_fqn", "to_fqn", "pipeline", "built_at"]
    return upsert_latest(edges.select(*cols), jobs.select(*cols), ["from_fqn", "to_fqn"], ["built_at", "pipeline"], parts=parts)


def usage_daily(log: DataFrame, asset: str, ts: str) -> DataFrame:
    """Query count per asset and day."""
    return log.groupBy(F.col(asset).alias("asset"), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("queries"))


def usage_rank(log: DataFrame, asset: str) -> DataFrame:
    """Assets by popularity. The window runs over one row per distinct count, not per
    asset: k different counts need at least k * k / 2 log rows, so ten trillion log
    rows give its single task under five million."""
    from pyspark.sql import Window

    totals = log.groupBy(F.col(asset).alias("asset")).agg(F.count(F.lit(1)).alias("queries"))
    by_count = totals.groupBy("queries").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.col("queries").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_count.select("queries", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("popularity_rank"))
    return totals.join(ranks, "queries")
