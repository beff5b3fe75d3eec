"""Hard negatives by exact integer scores from subset-sum tables.

Vectors are whole numbers, packed into bit planes: byte ``g`` of plane ``b`` holds bit ``b`` of the
eight components of group ``g`` in two's complement. For an anchor and a group, a table holds the sums
of all 256 subsets of the anchor's eight components. A plane's part of an inner product is then the sum
of one lookup a group, and the product itself is the planes' parts shifted and added, the sign plane
with a minus: a full, exact score without a multiplication a component.

Anchors are a stated share of the rows; they meet all rows in cells of bounded blocks, twice. The first
time finds each anchor's positives; the second time finds the other rows in the band below each
positive's score. A cell hands on the few best rows of an anchor (and positive), which are then
ranked over all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .registry import register

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores at least so many percent of the positive, and 100 at most.
LOWEST = 80
ANCHOR_EVERY = 100
#: Rows and anchors of a cell, on average.
BLOCK_ROWS = 8_192
BLOCK_ANCHORS = 512
GROUP = 8
#: Components of this size and more, with 2^16 of them, could pass 64 bits.
LIMIT = 1 << 23
#: Anchors whose tables are held at once.
TABLE_ANCHORS = 64


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as an integer; null for a vector that is null or empty, or holds a component
    that is null, not finite, or too large for exact scores of 64 bits."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    double = lambda x: x.cast("double")
    fine = (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(double(x)) & (F.abs(double(x)) * SCALE < LIMIT)
    )
    return F.when(fine, scaled).cast("array<int>")


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, planes, groups) bytes of (n, width) integers."""
    n, width = values.shape
    padded = np.zeros((n, -(-width // GROUP) * GROUP), np.int64)
    padded[:, :width] = values
    bits = (padded[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def planes_for(values: np.ndarray) -> int:
    """Bits that hold all values in two's complement."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return max(high.bit_length(), (~low).bit_length() if low < 0 else 0) + 1


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight components the sums of all its subsets."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    own = np.zeros((n, groups * GROUP), np.int64)
    own[:, :width] = anchors
    own = own.reshape(n, groups, GROUP).transpose(1, 2, 0)
    table = np.zeros((groups, 1 << GROUP, n), np.int64)
    for j in range(GROUP):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + own[:, j, None]
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(n, anchors) inner products from subset sums and bit planes, highest plane first."""
    n, planes, groups = packed.shape
    total = np.zeros((n, table.shape[2]), np.int64)
    for b in range(planes - 1, -1, -1):
        part = np.zeros_like(total)
        for g in range(groups):
            part += table[g][packed[:, b, g]]
        total = -part if b == planes - 1 else (total << 1) + part
    return total


def _best(found: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of places ``at`` by score, highest first; places ascend by vec_id, so ties go to the smaller one."""
    if len(at) > k:
        own = found[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.argsort(-found[at], kind="stable")][:k]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), width)


def _cells(rows: DataFrame, anchors: DataFrame, block_rows: int, block_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with the cells they meet in: every block of rows with every block of anchors of the same width."""
    sizes = rows.groupBy("width").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("row_blocks"))
    wanted = anchors.groupBy("width").agg(F.ceil(F.count("*") / block_anchors).cast("int").alias("anchor_blocks"))
    grid = settle(sizes.join(wanted, "width"), "negative-grid")  # one row a width
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")  # noqa: E731  keys of both sides have one type
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(grid, "width").withColumn("row_block", block(["vec_id", "v", "label"], "row_blocks")).withColumn("anchor_block", each("anchor_blocks"))
    right = anchors.join(grid, "width").withColumn("anchor_block", block(["anchor"], "anchor_blocks")).withColumn("row_block", each("row_blocks"))
    drop = ["row_blocks", "anchor_blocks"]
    return left.drop(*drop), right.drop(*drop)


def _scored(rows: pa.Table, anchors: pa.Table):
    """(i, scores of anchor i with the rows in vec_id order) of a cell; rows come back in that order."""
    rows = rows.sort_by("vec_id")
    width = rows["width"][0].as_py()
    own = _matrix(rows["v"], width)
    packed = pack_planes(own, planes_for(own))
    wanted = _matrix(anchors["v"], width)

    def each():
        for a in range(0, len(wanted), TABLE_ANCHORS):
            found = scores(subset_sums(wanted[a : a + TABLE_ANCHORS]), packed)
            for i in range(found.shape[1]):
                yield a + i, found[:, i]

    return rows, each()


def _labels(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as equal numbers for equal labels."""
    both = pa.chunked_array([*rows["label"].chunks, *anchors["label"].chunks]).combine_chunks().dictionary_encode()
    codes = np.asarray((pa.concat_arrays(both.chunks) if isinstance(both, pa.ChunkedArray) else both).indices)
    return codes[: len(rows)], codes[len(rows) :]


def _cell_positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "positive_id": [], "positive_score": []}
        if len(rows) and len(anchors):
            rows, found = _scored(rows, anchors)
            of_row, of_anchor = _labels(rows, anchors)
            ids = np.asarray(rows["vec_id"])
            number, own_id = anchors["anchor"].to_pylist(), anchors["vec_id"].to_pylist()
            for i, score in found:
                at = _best(score, np.flatnonzero((of_row == of_anchor[i]) & (ids != own_id[i])), k)
                out["anchor"] += [number[i]] * len(at)
                out["positive_id"] += ids[at].tolist()
                out["positive_score"] += score[at].tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def _cell_negatives(k: int, lowest: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "place": [], "negative_id": [], "negative_score": []}
        if len(rows) and len(anchors):
            rows, found = _scored(rows, anchors)
            of_row, of_anchor = _labels(rows, anchors)
            ids = np.asarray(rows["vec_id"])
            number, tops = anchors["anchor"].to_pylist(), anchors["tops"].to_pylist()
            for i, score in found:
                other = np.flatnonzero(of_row != of_anchor[i])
                own = score[other]
                for place, top in enumerate(tops[i]):
                    floor = -(-lowest * top // 100)  # whole numbers of any size
                    at = _best(score, other[(own <= top) & (own >= floor)], k)
                    out["anchor"] += [number[i]] * len(at)
                    out["place"] += [place] * len(at)
                    out["negative_id"] += ids[at].tolist()
                    out["negative_score"] += score[at].tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
    block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows that ``is_anchor`` picks.

    Needs vec_id (a whole number), embedding and label; other columns are ignored. Rows with a null vec_id, label or vector, an empty
    vector, or a component that is null, not finite or of 32,768 and more take no part; vectors meet those of their own width.
    Rows that repeat count once; rows that share a vec_id and differ otherwise are rows of their own, and
    no positive of one another. Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    rows = (
        vectors.select("vec_id", F.col("label").cast("string").alias("label"), quantised(F.col("embedding")).alias("v"), is_anchor.alias("chosen"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .withColumn("vec_id", F.col("vec_id").cast("long"))
        .distinct()
        .withColumn("width", F.size("v"))
    )
    rows = settle(rows, "negative-rows")
    chosen = rows.where("chosen").drop("chosen").withColumn("anchor", F.monotonically_increasing_id())
    anchors = settle(chosen, "negative-anchors")
    rows = rows.drop("chosen")
    cell = ["row_block", "anchor_block", "width"]

    left, right = _cells(rows, anchors, block_rows, block_anchors)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _cell_positives(positives), "anchor long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    listed = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("held"))
    with_tops = settle(anchors.join(listed, "anchor").withColumn("tops", F.col("held.positive_score")), "negative-positives")

    left, right = _cells(rows, with_tops.drop("held"), block_rows, block_anchors)
    hard = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _cell_negatives(negatives, lowest), "anchor long, place long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    own = with_tops.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("held").alias("place", "one"))
    return ranked.join(own.withColumn("place", F.col("place").cast("long")), ["anchor", "place"]).select(
        "anchor_id", F.col("one.positive_id").alias("positive_id"), "rank", "negative_id",
        F.col("one.positive_score").alias("positive_score"), "negative_score",
    )


CHECK = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {NEGATIVES}
"""


@register("op13_hard_negatives", CHECK)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % ANCHOR_EVERY == 0)
