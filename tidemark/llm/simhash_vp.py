"""SimHash near-duplicates found with vantage-point trees.

Texts with one fingerprint are one point. A tree over a bounded sample of the points cuts
the space: every node has a vantage point and a radius, and a point belongs inside or
outside by its Hamming distance. Each point has one home shard. It also visits every other
shard that may hold a partner: by the triangle inequality two points within ``RADIUS``
differ in their distance to any vantage point by ``RADIUS`` at most, so branches farther
than that from the boundary are pruned. Inside a shard the same rule goes on in memory,
down to blocks compared pair by pair, so every pair within the radius is met.

A shard does not list its pairs: it joins them at once and returns one link per point, to the
smallest point that it reaches in the shard. Links are contracted round by round to
components, each round a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import settle

from .common import documents
from .registry import register
from .subwords import slices

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Points that a shard should be home to; the number of shards follows from it.
SHARD_POINTS = 8_000
#: Sampled points for each leaf of the tree, and at most altogether.
SAMPLE_PER_SHARD, SAMPLE_LIMIT = 32, 65_536
#: Points compared pair by pair.
LEAF_POINTS = 256
#: Shingles whose bits are unpacked at once.
HASHES = 1 << 16
#: Characters of text held at once.
HELD_CHARS = 1 << 20
SIGN = np.uint64(1 << 63)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        found = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(a, min(n, a + HASHES))]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp): the columns ``keep`` of every row as one struct, and its text's fingerprint as a signed long; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for _, _, part in slices(batch.column(1), HELD_CHARS) for t in part)
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc", "fp"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("fp", T.LongType())]))


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def grow(sample: np.ndarray, leaves: int, seed: int = 1) -> list:
    """A tree over sampled points with at most about ``leaves`` leaves: nested [vantage, radius, inside, outside], or None for a leaf.

    The vantage point of a node is the one of a few candidates that spreads the node's points most.
    """
    rng = np.random.default_rng(seed)

    def node(points: np.ndarray, share: int):
        if share < 2 or len(points) < 4:
            return None
        tries = [points[i] for i in rng.integers(0, len(points), 6)]
        vantage = max(tries, key=lambda v: float(distance(points, v).std()))
        d = distance(points, vantage)
        radius = int(np.median(d))
        inside = d <= radius
        if inside.all() or not inside.any():
            return None
        return [vantage, radius, node(points[inside], share // 2), node(points[~inside], share - share // 2)]

    return node(np.unique(sample), leaves)


def route(tree, points: np.ndarray, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, shard, home) for every shard that a point lives in or has to visit."""
    index, shard, home = [], [], []
    todo = [(tree, 1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, name, at, own = todo.pop()
        if not len(at):
            continue
        if node is None:
            index.append(at)
            shard.append(np.full(len(at), name, np.int64))
            home.append(own)
            continue
        d = distance(points[at], node[0])
        inside = d <= node[1]
        # a home point visits inward only: its partner beyond the boundary visits it in turn
        goes_in, goes_out = d <= node[1] + reach, np.where(own, ~inside, d > node[1] - reach)
        todo.append((node[2], name * 2, at[goes_in], own[goes_in] & inside[goes_in]))
        todo.append((node[3], name * 2 + 1, at[goes_out], own[goes_out]))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(index), np.concatenate(shard), np.concatenate(home)


class Classes:
    """Smallest reachable index of each point, under pairs that come in blocks."""

    def __init__(self, size: int):
        self.of = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def shard_classes(points: np.ndarray, home: np.ndarray, reach: int = RADIUS) -> np.ndarray:
    """For each point of a shard the smallest index it is joined to through pairs of a home point and any other point."""
    classes = Classes(len(points))
    rng = np.random.default_rng(1)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        if len(own) > LEAF_POINTS:
            vantage = points[own[rng.integers(len(own))]]
            d, g = distance(points[own], vantage), distance(points[guests], vantage)
            radius = int(np.median(d))
            if (d <= radius).all():
                radius -= 1
            inside = d <= radius
            crossing = ~inside & (d <= radius + reach)
            one = (own[inside], np.concatenate([own[crossing], guests[g <= radius + reach]]))
            two = (own[~inside], guests[g > radius - reach])
            if inside.any() and max(len(one[0]) * (len(one[0]) + len(one[1])), len(two[0]) * (len(two[0]) + len(two[1]))) < 0.9 * len(own) * (
                len(own) + len(guests)
            ):
                todo += [one, two]
                continue
        everyone = np.concatenate([own, guests])
        for a in range(0, len(own), LEAF_POINTS):
            some = own[a : a + LEAF_POINTS]
            for b in range(a, len(everyone), 1 << 14):
                others = everyone[b : b + (1 << 14)]
                x, y = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[others][None, :]) <= reach)
                classes.join(some[x], others[y])
    return classes.of


def links(points: DataFrame, n_points: int, reach: int = RADIUS) -> DataFrame:
    """(a, b) with a > b: enough pairs of points to connect all that are within ``reach`` of each other through others.

    ``points`` has one column fp without repeats. Shards are as many as ``n_points`` asks for; only
    the sample that the tree grows from reaches the driver.
    """
    spark = points.sparkSession
    shards = max(1, n_points // SHARD_POINTS)
    size = min(SAMPLE_LIMIT, shards * SAMPLE_PER_SHARD)
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(size).collect() if shards > 1 else []
    tree = grow(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), min(shards, max(1, size // 8)))
    shared = spark.sparkContext.broadcast(tree)  # SAMPLE_LIMIT nodes at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            index, shard, home = route(shared.value, fp.view(np.uint64), reach)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[index]), pa.array(home)], ["shard", "fp", "home"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", kind="stable")
        fp = rows["fp"].to_numpy()
        of = shard_classes(fp.view(np.uint64), rows["home"].to_numpy(bool), reach)
        linked = np.flatnonzero(of != np.arange(len(of)))
        return pd.DataFrame({"a": fp[linked], "b": fp[of[linked]]})

    sent = points.select("fp").mapInArrow(send, "shard bigint, fp bigint, home boolean")
    return sent.groupBy("shard").applyInPandas(meet, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list (a, b) reaches.

    Every round points each node at its smallest neighbour, follows the pointers twice, and replaces both
    ends of each edge by what they point to; edges inside one component vanish. The pointers of all rounds
    are applied to the nodes in turn. Every step is a stored table with its size known, so hot roots
    meet in joins that AQE can broadcast or split.
    """
    edges = settle(edges.where("a <> b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "pointers")
        for _ in range(2):
            further = low.select(F.col("a").alias("to"), F.col("to").alias("next"))
            low = settle(low.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "pointers")
        rounds.append(low)
        first = edges.join(low, "a").select(F.col("to").alias("a"), "b")
        second = first.join(low.select(F.col("a").alias("b"), F.col("to").alias("to")), "b").select("a", F.col("to").alias("b"))
        edges = settle(second.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark = edges.sparkSession
    if not rounds:
        return spark.createDataFrame([], "node bigint, root bigint")
    out = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for low in rounds[1:]:
        step = low.select(F.col("a").alias("root"), F.col("to").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def component_firsts(marked: DataFrame, first: Column, reach: int = RADIUS) -> DataFrame:
    """(fp, first): for every fingerprint of ``marked`` the smallest ``first`` among all rows of its component."""
    points = settle(marked.groupBy("fp").agg(F.min(first).alias("own")), "points")
    found = settle(components(links(points, points.count(), reach)), "components")
    named = found.join(points, found["node"] == points["fp"]).groupBy("root").agg(F.min("own").alias("first"))
    of_linked = found.join(settle(named, "names"), "root").select(F.col("node").alias("fp"), "first")
    return settle(points.join(of_linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")), "firsts")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. Null and empty texts have fingerprint 0
    and are linked like any other; a row without doc_id belongs to its component but never
    names it (a component of such rows only has a null name); rows that repeat share a
    component; an empty table gives an empty result.
    """
    marked = settle(fingerprints(docs, ["doc_id"], shingle), "fingerprints").select("doc.doc_id", "fp")
    return marked.join(component_firsts(marked, F.col("doc_id"), reach), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: one of those with the smallest doc_id, null last.

    Rows are numbered in a stored copy, so exactly one of rows that repeat stays.
    """
    marked = fingerprints(docs, docs.columns, shingle).withColumn("row", F.monotonically_increasing_id())
    marked = settle(marked, "numbered")
    first = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
    chosen = component_firsts(marked, first, reach)
    stay = settle(chosen.select(F.col("first.row").alias("row")).distinct(), "chosen")
    # the list of rows grows with the documents, so it is never broadcast: one plan at every size
    return marked.join(stay.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


@register("op4_simhash_components")
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
