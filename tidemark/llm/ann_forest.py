"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree parts a bounded sample at the median of a random projection, again and again;
every vector is then sent to its leaf in every tree. A query walks all trees at once: one
priority queue holds the open nodes of the whole forest, ordered by the smallest distance
to a boundary on the way there, and hands out leaves until the budget of leaves is used
up and they hold enough different ids. The vectors of those leaves are the candidates, ranked by their exact cosine.

Leaves are counted first. A leaf of over twice the mean size, as a vector that a third of all rows share
would make it, or of more than ``PART_ROWS`` vectors is dealt over several tasks, and queries visit all its
parts; the visits of a leaf are dealt in parts of ``PART_QUERIES`` at most. Vectors travel in the type they are stored in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import settle

from .registry import register

TREES = 4
LEAVES = 64  # of each tree
#: Share of all leaves of the forest that a query may visit. The given vectors are nearly uniform on the
#: sphere, so neighbours are barely nearer than others and much of the index has to be looked at; vectors with structure need less.
VISIT = 0.27
SAMPLE = 8_192  # vectors that the trees are made from, by the order of a hash
PART_ROWS, PART_QUERIES = 20_000, 20_000
#: Rows that a part of a leaf should have at least.
LEAST_PART = 256
PLACE = ["width", "tree", "leaf"]
QUERY_EVERY = 50
K = 5
#: Candidates scored at once for the queries of a leaf.
SCORED = 1 << 22


def component(vectors: DataFrame) -> str:
    """The type that holds the components of a table's vectors exactly: float where they are stored so, else double."""
    held = vectors.schema["embedding"].dataType
    return "float" if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else "double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and width: vectors of finite components and some length other than 0; components stay floats or become doubles."""
    e = F.col("embedding").cast(f"array<{component(vectors)}>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(e, lambda x: x != 0)
    )
    return rows.withColumn("width", F.size("embedding"))


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> list:
    """A tree as a list of nodes: (direction, middle, below, above), or None for a leaf."""
    nodes: list = []

    def node(rows: np.ndarray, share: int) -> int:
        here = len(nodes)
        nodes.append(None)
        if share >= 2 and len(rows) >= 2:
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            along = sample[rows] @ direction
            middle = float(np.median(along))
            above = along > middle
            if above.any():
                below = node(rows[~above], share // 2)
                nodes[here] = (direction, middle, below, node(rows[above], share - share // 2))
        return here

    node(np.arange(len(sample)), leaves)
    return nodes


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is taken out first, so nothing overflows or vanishes."""
    vectors = np.asarray(vectors, np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def leaf_of(nodes: list, vectors: np.ndarray) -> np.ndarray:
    """The leaf (number of its node) of each unit vector."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(0, np.arange(len(vectors)))]
    while todo:
        name, rows = todo.pop()
        if nodes[name] is None:
            out[rows] = name
        else:
            direction, middle, below, above = nodes[name]
            up = vectors[rows] @ direction > middle
            todo += [(below, rows[~up]), (above, rows[up])]
    return out


def visited(
    forest: list[list], vector: np.ndarray, budget: int, heads: dict[tuple[int, int], tuple] | None = None, own: int | None = None, k: int = 0
) -> list[tuple[int, int]]:
    """The (tree, leaf) that a unit vector visits: one queue over all trees, nearest boundary first.

    At least ``budget`` leaves, and on until they hold ``k`` different ids besides ``own`` or none is left. ``heads``
    has ``k + 1`` ids of each leaf, or all if there are fewer, which settles that exactly.
    """
    margins = []
    for nodes in forest:
        inner = [n for n in nodes if n is not None]
        along = iter(np.array([n[0] for n in inner]) @ vector - np.array([n[1] for n in inner])) if inner else iter(())
        margins.append([None if n is None else float(next(along)) for n in nodes])
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    found = []
    covered: set = set()
    while queue and (len(found) < budget or len(covered) < k):
        worst, t, name = heapq.heappop(queue)
        node = forest[t][name]
        if node is None:
            found.append((t, name))
            if len(covered) < k:
                covered.update(heads.get((t, name), ()))
                covered.discard(own)
            continue
        margin = margins[t][name]
        heapq.heappush(queue, (max(worst, -margin), t, node[3]))
        heapq.heappush(queue, (max(worst, margin), t, node[2]))
    return found


def best_of_leaf(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` candidates (different ids) of one part of a leaf with the largest cosine, for each query that visits it."""
    out = []
    if len(vectors) and len(queries):
        ids = vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        base = unit(np.stack(vectors["embedding"].to_numpy())[order])
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        asked = queries["query_id"].to_numpy()
        points = unit(np.stack(queries["embedding"].to_numpy()))
        step = max(1, SCORED // len(ids))
        for a in range(0, len(asked), step):
            score = points[a : a + step] @ base.T
            score[asked[a : a + step][:, None] == ids[None, :]] = -np.inf
            by_id = np.maximum.reduceat(score, starts, axis=1) if len(starts) < len(ids) else score
            for i, (s, top) in enumerate(zip(score, by_id, strict=True), a):
                # rounding may part equal vectors by a hair: everything near the k-th id stays for the exact ranking
                least = np.partition(top, -k)[-k] if len(top) > k else -np.inf
                near = np.flatnonzero(s >= least - 1e-9) if np.isfinite(least) else np.flatnonzero(np.isfinite(s))
                exact = (base[near] * points[i]).sum(axis=1)
                order = np.lexsort((ids[near], -exact))
                _, first = np.unique(ids[near][order], return_index=True)
                best = order[np.sort(first)][:k]
                out.append(pd.DataFrame({"query_id": asked[i], "vec_id": ids[near[best]], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def parts_of(rows: DataFrame, most: int, balanced: bool) -> Column:
    """Parts that the rows of a leaf are dealt over: none has above ``most`` rows nor, where ``balanced``, above twice the mean leaf."""
    counts = rows.groupBy(*PLACE).count().collect()  # a row per leaf of the forest at most
    if balanced and counts:
        most = min(most, max(LEAST_PART, 2 * sum(r["count"] for r in counts) // len(counts)))
    large = {":".join(str(r[c]) for c in PLACE): -(-r["count"] // most) for r in counts if r["count"] > most}
    if not large:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
    return F.coalesce(table[F.concat_ws(":", *PLACE)], F.lit(1))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaves: int = LEAVES, visit: float = VISIT, seed: int = 3
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``queries`` the ``k`` nearest found rows of ``vectors``, its own id left out.

    Both need vec_id and embedding; other columns are ignored. Rows with a null id, a null or empty vector, null or
    non-finite components or length 0 take no part; vectors of another width than the query's never meet it, as
    each width has its own forest. Ties go to the smaller vec_id; rows that repeat a vec_id
    are one candidate, as near as the nearest of them; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # repeats are one candidate; all copies would be dealt to one part of a leaf
    rows = settle(usable(vectors).dropDuplicates(["vec_id", "embedding"]), "vectors")
    asked = usable(queries).dropDuplicates(["vec_id", "embedding"])
    widths = [r["width"] for r in rows.select("width").distinct().collect()]
    rng = np.random.default_rng(seed)
    forests = {}
    for width in sorted(widths):
        own = rows.where(F.col("width") == width)
        picked = own.orderBy(F.xxhash64("embedding"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        sample = unit(np.stack(picked.to_numpy()))
        forests[width] = [grow(sample, leaves, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forests)  # trees * leaves directions a width

    def numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held = batch.column(1)
        width = np.asarray(batch.column(2))
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            flat = np.asarray(held.take(pa.array(at)).flatten())
            yield int(w), at, unit(flat.reshape(len(at), int(w)))

    kinds = {"vec_id": component(vectors), "query_id": component(queries)}
    arrow = {key: pa.list_(pa.float32() if kind == "float" else pa.float64()) for key, kind in kinds.items()}

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, at, points in numbered(batch):
                for t, nodes in enumerate(shared.value[w]):
                    own = batch.take(pa.array(at))
                    size = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, w, np.int32)), pa.array(np.full(size, t, np.int32)), pa.array(leaf_of(nodes, points).astype(np.int32)),
                         own.column(0), own.column(1).cast(arrow["vec_id"])],
                        ["width", "tree", "leaf", "vec_id", "embedding"],
                    )

    def to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for w, at, points in numbered(batch):
                for t, nodes in enumerate(shared.value[w]):
                    pairs = np.unique(np.stack([leaf_of(nodes, points), ids[at]]), axis=1)
                    leaf, vec = pairs
                    nth = np.arange(len(leaf)) - np.searchsorted(leaf, leaf)
                    leaf, vec = leaf[nth <= k], vec[nth <= k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(leaf), x, np.int32)) for x in (w, t)] + [pa.array(leaf.astype(np.int32)), pa.array(vec)],
                        ["width", "tree", "leaf", "vec_id"],
                    )

    nth = F.row_number().over(Window.partitionBy(*PLACE).orderBy("vec_id"))
    first_ids = rows.mapInArrow(to_heads, "width int, tree int, leaf int, vec_id bigint").distinct().withColumn("nth", nth)
    held_ids: dict[int, dict[tuple[int, int], tuple]] = {w: {} for w in widths}
    for r in first_ids.where(F.col("nth") <= k + 1).groupBy(*PLACE).agg(F.collect_list("vec_id").alias("ids")).collect():
        held_ids[r["width"]][r["tree"], r["leaf"]] = tuple(r["ids"])  # k + 1 ids a leaf at most
    shared_heads = spark.sparkContext.broadcast(held_ids)

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, at, points in numbered(batch):
                if w not in shared.value:
                    continue
                forest = shared.value[w]
                budget = max(1, round(visit * sum(n is None for nodes in forest for n in nodes)))
                heads = shared_heads.value[w]
                for i, point in zip(at, points, strict=True):
                    found = visited(forest, point, max(budget, len(forest)), heads, batch.column(0)[int(i)].as_py(), k)
                    one = batch.take(pa.array([i] * len(found)))
                    tree, leaf = (pa.array(x, pa.int32()) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w] * len(found), pa.int32()), tree, leaf, one.column(0), one.column(1).cast(arrow["query_id"])],
                        ["width", "tree", "leaf", "query_id", "embedding"],
                    )

    schema = "width int, tree int, leaf int, {0} bigint, embedding array<{1}>"
    index = rows.mapInArrow(to_leaves, schema.format("vec_id", kinds["vec_id"]))
    visits = asked.mapInArrow(to_visits, schema.format("query_id", kinds["query_id"]))
    parts, blocks = parts_of(index, PART_ROWS, balanced=True), parts_of(visits, PART_QUERIES, balanced=False)
    keys = [*PLACE, "part", "block"]
    dealt = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), parts).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    spread = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))
    )

    def rank(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return best_of_leaf(one, other, k)

    found = (
        dealt.groupBy(*keys).cogroup(spread.groupBy(*keys))
        .applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    )
    # the rows of a query, k a visited part, meet once for both steps below
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register("op5_forest_neighbours")
def op5_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
