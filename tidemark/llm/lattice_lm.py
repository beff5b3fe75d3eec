"""Language-model scores by subword lattices.

The model gives each piece of an existing public vocabulary a probability: its scores there (merge
ranks) make a prior, and the pieces of the training words, as the vocabulary's library cuts them,
are counted on top. A word's probability is the sum over all ways to cut it into pieces, found by a
forward recursion in log space; single bytes are pieces too, so every word has one. A text is its words and one end.

Documents are taken apart in blocks of bounded size: a block keeps each of its words once, and each
document as (word, times). Only (block, word) rows are shuffled to count words over the corpus, so a word
that is in every document moves once a block; counts and lattice scores go back to the blocks packed, one
row for each task and block. Nothing about the size of the corpus's vocabulary is assumed.

A stored row holds one document or a run of a block's words, never a whole block: readers, writers and sorts hold
rows by their number, so rows of megabytes would make memory grow with the size of files. A block is put together
only where its documents meet their scores, one block at a time.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .common import crc_share, documents
from .registry import register
from .subwords import piece_model, slices, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
HELD_OUT = (7, 2)  # documents whose crc32 modulo the first is the second are not learnt from
BLOCK_CHARS = 4 << 20
#: Words of a block that share a stored row.
WORDS_ROW = 1024
#: What goes back to a block for each of its words, and how many of them a task holds before it sends them.
ENTRY = np.dtype([("at", "<i4"), ("c", "<i8"), ("lattice", "<f8")])
PACKED_ROWS = 2_000_000
#: Bytes that a task sends at once of what it holds.
SEND_BYTES = 4 << 20
#: Pseudo-counts that the prior from the vocabulary's scores adds, per piece.
PRIOR_WEIGHT = 1.0
#: Shift of the rank in the prior 1 / (rank + shift).
PRIOR_SHIFT = 2.7

_BLOCK = (
    "block bigint, doc_id {id}, held_out boolean, n_words bigint, word array<int>, times array<int>, "
    "at int, words array<string>, train array<bigint>"
)


def blocks(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents as two kinds of rows: a document as (word, times), and ``words`` of its block from place ``at`` on with their training counts.

    Columns of the other kind are null; n_words is null for rows of words only.
    """
    rows = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.coalesce(crc_share(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)).alias("held_out"),
    )
    schema = _BLOCK.format(id=rows.schema["doc_id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, out = batch.column(0), batch.column(2).to_pylist()
            for a, b, texts in slices(batch.column(1), chars):
                place: dict[bytes, int] = {}
                train = array("q")
                word, times = array("i"), array("i")
                first, n_words = [0], []
                for i, text in enumerate(texts, a):
                    found = Counter(text.encode().lower().split())
                    for w, n in found.items():
                        k = place.setdefault(w, len(place))
                        if k == len(train):
                            train.append(0)
                        if not out[i]:
                            train[k] += n
                        word.append(k)
                        times.append(n)
                    n_words.append(found.total())
                    first.append(len(word))
                size = b - a
                of_docs = [
                    pa.array([number] * size, pa.int64()), ids.slice(a, size), pa.array(out[a:b], pa.bool_()), pa.array(n_words, pa.int64()),
                    _lists(first, word, pa.int32()), _lists(first, times, pa.int32()),
                    pa.nulls(size, pa.int32()), pa.nulls(size, pa.list_(pa.string())), pa.nulls(size, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(of_docs, names)
                at = range(0, len(place), WORDS_ROW)
                if at:
                    ends, size = [*at, len(place)], len(at)
                    of_words = [
                        pa.array([number] * size, pa.int64()), pa.nulls(size, ids.type), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.int64()),
                        pa.nulls(size, pa.list_(pa.int32())), pa.nulls(size, pa.list_(pa.int32())), pa.array(at, pa.int32()),
                        _lists(ends, [w.decode() for w in place], pa.string()), _lists(ends, train, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(of_words, names)
                number += 1

    return rows.mapInArrow(run, schema)


def _lists(ends: list[int], values, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def vocabulary_pieces(path: str) -> tuple[list[bytes | None], list[float]]:
    """The bytes of each piece (None for control pieces) and its prior probability."""
    model = piece_model(path)
    texts: list[bytes | None] = []
    weights = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            texts.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            weights.append(1 / (model.get_piece_size() + PRIOR_SHIFT))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(None)
            weights.append(0.0)
        else:
            texts.append(model.id_to_piece(i).replace("▁", " ").encode())
            weights.append(1 / (min(-model.get_score(i), model.get_piece_size()) + PRIOR_SHIFT))
    total = sum(weights)
    return texts, [w / total for w in weights]


def counted_words(held: DataFrame) -> DataFrame:
    """(word, block, at, c, lead): every word of every block with its count in the training documents; lead marks one row a word.

    One shuffle by word; a group has a row for each block that holds the word.
    """
    runs = held.where(F.col("words").isNotNull()).select("block", "at", F.posexplode(F.arrays_zip("words", "train")).alias("k", "w"))
    listed = runs.select("block", (F.col("at") + F.col("k")).alias("at"), F.col("w.words").alias("word"), F.col("w.train").alias("train"))
    whole = Window.partitionBy("word")
    first = F.struct("block", "at")
    return listed.withColumns({"c": F.sum("train").over(whole), "first": F.min(first).over(whole)}).select(
        "word", "block", "at", "c", (F.col("first") == first).alias("lead")
    )


def piece_counts(vocab: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often the library's cuts of the training words (word, c) hold each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        n = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            cuts = model.encode(batch.column(0).to_pylist(), num_threads=1)
            ids = np.fromiter(chain.from_iterable(cuts), np.int64)
            np.add.at(n, ids, np.repeat(np.asarray(batch.column(1)), [len(cut) for cut in cuts]))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["piece", "n"])

    return vocab.select("word", "c").mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def forward(text: bytes, log_p: dict[bytes, float], longest: int) -> float:
    """Natural log of the sum over all cuts of ``text`` into pieces of the product of their probabilities."""
    reach = [0.0]
    for end in range(1, len(text) + 1):
        ways = [
            reach[begin] + p
            for begin in range(max(0, end - longest), end)
            if (p := log_p.get(text[begin:end])) is not None
        ]
        if len(ways) == 1:
            reach.append(ways[0])
        else:
            top = max(ways)
            reach.append(top + math.log(sum([math.exp(w - top) for w in ways])))
    return reach[-1]


def block_scores(counted: DataFrame, log_p: dict[bytes, float]) -> DataFrame:
    """(block, packed): places, counts and log10 lattice probabilities of a block's words, as ``ENTRY`` records.

    Rows of one word stand together, so its lattice is run once a task.
    """
    shared = counted.sparkSession.sparkContext.broadcast(log_p)  # one entry per piece of the vocabulary file
    longest = max(map(len, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        held = np.empty(PACKED_ROWS, [("block", "<i8"), *ENTRY.descr])
        rows, last, lattice = 0, None, 0.0

        def flush() -> Iterator[pa.RecordBatch]:
            """Block by block from what is held, which is neither copied nor sent as a whole."""
            of = held["block"][:rows]
            order = np.argsort(of, kind="stable")
            ends = [*(np.flatnonzero(np.diff(of[order])) + 1).tolist(), rows]
            blocks, packed, size, begin = [], [], 0, 0
            for end in ends:
                part = held[order[begin:end]]
                blocks.append(int(part["block"][0]))
                packed.append(part[list(ENTRY.names)].astype(ENTRY).tobytes())
                size, begin = size + len(packed[-1]), end
                if size >= SEND_BYTES or end == rows:
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], ["block", "packed"])
                    blocks, packed, size = [], [], 0

        for batch in batches:
            if rows and rows + batch.num_rows > len(held):
                yield from flush()
                rows = 0
            if batch.num_rows > len(held):
                held = np.empty(batch.num_rows, held.dtype)
            part = held[rows : rows + batch.num_rows]
            for i, name in enumerate(("block", "at", "c"), 1):
                part[name] = np.asarray(batch.column(i))
            scores = []
            for w in batch.column(0).to_pylist():
                if w != last:
                    last, lattice = w, forward(b" " + w.encode(), table, longest) / math.log(10)
                scores.append(lattice)
            part["lattice"] = scores
            rows += len(part)
        if rows:
            yield from flush()

    return counted.select("word", "block", "at", "c").mapInArrow(run, "block bigint, packed binary")


def score(docs: DataFrame, vocabulary: str | None = None, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or empty text is its end
    alone; a null doc_id is learnt from; rows that repeat count as often as they stand
    there; with nothing to learn from, base_score is that of V = N = 0 and score that of the prior; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path(VOCABULARY)
    held = settle(blocks(docs, held_out), "lm-blocks")
    counted = settle(counted_words(held), "lm-words")
    vocab = counted.where("lead and c > 0")
    totals = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    in_blocks = held.where(F.col("n_words").isNotNull()).select("block", "doc_id", "held_out", "n_words", "word", "times")
    ends = in_blocks.agg(F.count_if(~F.col("held_out"))).first()[0]
    n, v = totals["n"] + ends, totals["v"] + (ends > 0)

    texts, prior = vocabulary_pieces(path)
    counts = np.zeros(len(texts) + 1)  # the last is the end
    counts[-1] = ends
    for row in piece_counts(vocab, path).collect():  # a row per piece of the vocabulary file at most
        counts[row["piece"]] += row["n"] * (texts[row["piece"]] is not None)
    mass = PRIOR_WEIGHT * len(texts)
    weights = counts + mass * np.array([*prior, 1 / len(texts)])
    weights /= weights.sum()
    log_p: dict[bytes, float] = {}
    for text, w in zip(texts, weights, strict=False):
        if text is not None and w > 0:  # a byte and a letter may be the same text
            log_p[text] = float(np.logaddexp(log_p.get(text, -np.inf), np.log(w)))
    end_lattice = float(np.log10(weights[-1]))
    packed = block_scores(counted, log_p)
    base_all = math.log10(n + v + 1)

    def run(rows: pa.Table, scores: pa.Table) -> pa.Table:
        """The documents of one block; a block without words has no scores."""
        size = rows.num_rows
        lists = rows.column("word").combine_chunks()
        doc = np.repeat(np.arange(size), np.diff(np.asarray(lists.offsets)))
        word = np.asarray(lists.flatten())
        times = np.asarray(rows.column("times").combine_chunks().flatten())
        found = np.frombuffer(b"".join(scores.column("packed").to_pylist()), ENTRY)
        found = found[np.argsort(found["at"])][word]
        c, lattice = found["c"], found["lattice"]
        base = np.bincount(doc, (np.log10(c + 1.0) - base_all) * times, size) + math.log10(ends + 1) - base_all
        total = np.bincount(doc, lattice * times, size) + end_lattice
        known = np.bincount(doc, (c > 0) * times, size).astype(np.int64) + (ends > 0)
        tokens = np.asarray(rows.column("n_words")) + 1
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": tokens, "n_known": known,
                "train_tokens": np.full(size, n, np.int64), "base_score": base, "score": total,
            }
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (
        in_blocks.groupBy("block")
        .cogroup(packed.groupBy("block"))
        .applyInArrow(
            run,
            f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        )
    )


@register("op6_lattice_scores")
def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
