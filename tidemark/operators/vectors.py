"""Exact nearest-vector search.

Three plans, all exact, chosen by measured sizes:

* few queries: they are sent to every task, the corpus is scanned once without a
  shuffle and each task hands on its own top k;
* few corpus rows (nearest stored pattern): the corpus is sent, queries are mapped;
* neither fits: both sides are cut into blocks, each pair of blocks is one bounded
  group, and the per-block top k are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.shaping import topk

SENT_ROWS = 4096  # vectors sent to every task at most
SENT_VALUES = 8_000_000  # and at most this many numbers (64 MB as double)
BLOCK = 2048  # vectors multiplied at once
DIGITS = 9  # similarities are compared at this precision, so copies tie exactly

RESULT = "query_id long, item_id long, owner_id long, similarity double"


def _matrix(column) -> np.ndarray:
    """Unit rows of vectors of one width; zero vectors stay zero."""
    out = np.array([np.asarray(v, np.float64) for v in column])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _by_width(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and unit rows of the vectors of each width; null and empty vectors match nothing."""
    at: dict[int, list[int]] = {}
    for i, v in enumerate(column):
        if v is not None and len(v):
            at.setdefault(len(v), []).append(i)
    return {w: (np.asarray(held), _matrix([column[i] for i in held])) for w, held in at.items()}


def _best(scores: np.ndarray, items: np.ndarray, owners: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best owners of one query: score down, owner up, item up;
    each owner once, by its best item."""
    order = np.lexsort((items, owners, -scores))
    _, first = np.unique(owners[order], return_index=True)
    return order[np.sort(first)][:k]


def _block_topk(qids, q, items, owners, c, k) -> pd.DataFrame:
    """Top k of every query against the corpus rows given, in blocks."""
    kept: list[tuple] = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qids]
    for at in range(0, len(items), BLOCK):
        sims = np.round(q @ c[at : at + BLOCK].T, DIGITS)
        it, ow = items[at : at + BLOCK], owners[at : at + BLOCK]
        # a full list is only touched by scores that reach its last place
        floor = np.array([r[0][-1] if len(r[0]) == k else -np.inf for r in kept])
        reach = sims >= floor[:, None]
        for i in np.flatnonzero(reach.any(axis=1)):
            m = reach[i]
            s = np.concatenate([kept[i][0], sims[i][m]])
            its = np.concatenate([kept[i][1], it[m]])
            ows = np.concatenate([kept[i][2], ow[m]])
            pick = _best(s, its, ows, k)
            kept[i] = (s[pick], its[pick], ows[pick])
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.asarray(qids, np.int64), [len(r[0]) for r in kept]),
            "item_id": np.concatenate([r[1] for r in kept]) if kept else [],
            "owner_id": np.concatenate([r[2] for r in kept]) if kept else [],
            "similarity": np.concatenate([r[0] for r in kept]) if kept else [],
        }
    )


def _matches(qids, q, items, owners, c, k) -> pd.DataFrame:
    """Top k of every query against the corpus rows of its own width."""
    qids, found = np.asarray(qids, np.int64), []
    for width in q.keys() & c.keys():
        (asked, left), (held, right) = q[width], c[width]
        found.append(_block_topk(qids[asked], left, items[held], owners[held], right, k))
    return pd.concat(found) if found else _block_topk([], np.empty((0, 1)), np.empty(0), np.empty(0), np.empty((0, 1)), k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best item per (query, owner), then the k best owners per query."""
    order = F.struct(-F.col("similarity"), F.col("item_id"))
    per_owner = found.groupBy("query_id", "owner_id").agg(
        F.min_by(F.struct("similarity", "item_id"), order).alias("_b")
    )
    flat = per_owner.select("query_id", "_b.item_id", "owner_id", "_b.similarity")
    return topk(flat, ["query_id"], [F.col("similarity").desc(), F.col("owner_id")], k)


def _small(df: DataFrame) -> list | None:
    """The rows if they are proven few, else None. Reads at most SENT_ROWS + 1 rows."""
    head = df.limit(SENT_ROWS + 1).collect()
    values = sum(len(r["vec"] or ()) for r in head)
    return head if len(head) <= SENT_ROWS and values <= SENT_VALUES else None


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """k nearest owners per query by cosine, each by its best vector.

    ``queries`` has (query_id long, vec), ``corpus`` (item_id long, owner_id long,
    vec); filter the corpus by type beforehand. Ties go to the smaller owner id. Vectors
    meet those of their own width only, however the rows are dealt.
    """
    spark = queries.sparkSession
    sent = _small(queries)
    if sent is not None:
        if not sent:
            return spark.createDataFrame([], RESULT)
        ids = [r["query_id"] for r in sent]
        shared = spark.sparkContext.broadcast((ids, _by_width([r["vec"] for r in sent])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            parts = None
            for b in batches:
                if len(b):
                    got = _matches(
                        qids, q, b["item_id"].to_numpy(), b["owner_id"].to_numpy(), _by_width(b["vec"].tolist()), k
                    )
                    parts = got if parts is None else _trim(pd.concat([parts, got]), k)
            if parts is not None:
                yield parts

        # each task hands on at most k rows per query
        return _merge(corpus.select("item_id", "owner_id", "vec").mapInPandas(scan, RESULT), k)
    sent = _small(corpus)
    if sent is not None:
        items = np.asarray([r["item_id"] for r in sent], np.int64)
        owners = np.asarray([r["owner_id"] for r in sent], np.int64)
        shared = spark.sparkContext.broadcast((items, owners, _by_width([r["vec"] for r in sent])))

        def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it, ow, c = shared.value
            for b in batches:
                for at in range(0, len(b), BLOCK):
                    part = b.iloc[at : at + BLOCK]
                    yield _matches(part["query_id"].tolist(), _by_width(part["vec"].tolist()), it, ow, c, k)

        return queries.select("query_id", "vec").mapInPandas(lookup, RESULT)
    return _merge(_grid(queries, corpus, k), k)


def _trim(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k owners per query of rows gathered so far in one task."""
    ranked = found.sort_values(["query_id", "similarity", "owner_id", "item_id"], ascending=[True, False, True, True])
    return ranked.drop_duplicates(["query_id", "owner_id"]).groupby("query_id").head(k)


def _grid(queries: DataFrame, corpus: DataFrame, k: int, q_block: int = SENT_ROWS, c_block: int = 65_536) -> DataFrame:
    """Block pairs as bounded groups: queries are copied to every corpus block and the
    corpus to every query block. Block numbers hash the whole row and copies are
    dropped first, so no block outgrows its share; its size follows the vector width."""
    # a repeated row changes no result, but all its copies would hash to one block
    queries = queries.dropDuplicates(["query_id", "vec"])
    corpus = corpus.select("item_id", "owner_id", "vec").dropDuplicates()
    width = max(1, corpus.agg(F.max(F.size("vec"))).first()[0] or 1)
    c_block = max(1, min(c_block, SENT_VALUES // width))
    n_q = max(1, math.ceil(queries.count() / q_block))
    n_c = max(1, math.ceil(corpus.count() / c_block))
    every_c = F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    q = queries.select(
        F.pmod(F.xxhash64("query_id", "vec"), F.lit(n_q)).cast("int").alias("qb"), every_c.alias("cb"), "query_id", "vec"
    )
    c = corpus.select(
        every_q.alias("qb"), F.pmod(F.xxhash64("item_id", "owner_id", "vec"), F.lit(n_c)).cast("int").alias("cb"),
        "item_id", "owner_id", "vec",
    )

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _matches(
            left["query_id"].tolist(), _by_width(left["vec"].tolist()),
            right["item_id"].to_numpy(), right["owner_id"].to_numpy(), _by_width(right["vec"].tolist()), k,
        )

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(cell, RESULT)


def nearest(queries: DataFrame, stored: DataFrame, min_similarity: float = 0.92) -> DataFrame:
    """The nearest stored vector of every query; a miss (null item) below the limit, or of similarity 0 without one of its width."""
    best = queries.select("query_id").distinct().join(vector_topk(queries, stored, 1), "query_id", "left")
    hit = F.coalesce(F.col("similarity") >= min_similarity, F.lit(False))
    return best.select(
        "query_id", F.when(hit, F.col("item_id")).alias("item_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), hit.alias("hit")
    )


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per label, summed in DECIMAL by position: no vectors are gathered."""
    parts = df.select(label, F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(
        F.sum(F.col("x").cast("double").cast("decimal(20,10)")).cast("double").alias("s"), F.count("x").alias("n")
    )
    # one row per dimension: the array has as many entries as a vector has
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda r: r["m"]).alias(vec)
    )


def stable_id(*cols) -> Column:
    """Hash key of an asset, the same on every run."""
    return F.sha2(F.concat_ws("\u0001", *cols), 256)
