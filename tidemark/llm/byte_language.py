"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes in both directions, labels every position with
a distribution over the learnt languages, and a document's distribution is the mean over
all its positions. It is trained in numpy by backpropagation through time on a bounded
sample: ``PER_LANGUAGE`` windows of each language, fewer where there are more than ``LANGUAGES``
of them, one window a document, picked by hash over all labelled documents and over the whole length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.shaping import topk

from .common import crc_share, documents
from .registry import register
from .subwords import slices

HIDDEN = 8
STEPS = 128  # bytes of a window
PER_LANGUAGE = 700
LANGUAGES = 64
EPOCHS = 14
BATCH = 128
RATE = 0.02
#: Windows that run through the network together, and characters of text held at once.
ROWS = 2048
HELD_CHARS = 1 << 20
#: Blocks in which the windows of a language are ranked.
BLOCKS = 16
UNKNOWN = "und"


class Network:
    """Weights of both directions: byte inputs (256, 3H), recurrent weights (H, 3H), and the labelling layer.

    The three parts of a gate block are update, reset and candidate.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.w: dict[str, np.ndarray] = {}
        for side in ("f", "b"):
            self.w[f"in_{side}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"rec_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"out_{side}"] = rng.normal(0, 0.3, (hidden, classes)).astype(np.float32)
        self.w["bias"] = np.zeros(classes, np.float32)

    def _read(self, x: np.ndarray, valid: np.ndarray | None, side: str, keep: bool):
        """States (steps, rows, H) after each step of ``x`` (steps, rows); gates too if ``keep``."""
        h_size = self.hidden
        inputs, rec = self.w[f"in_{side}"], self.w[f"rec_{side}"]
        half = np.concatenate([np.full(2 * h_size, 0.5), np.ones(h_size)]).astype(np.float32)
        inputs, rec = inputs * half, rec * half  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        gate_rec, new_rec = np.ascontiguousarray(rec[:, : 2 * h_size]), np.ascontiguousarray(rec[:, 2 * h_size :])
        steps, rows = x.shape
        states = np.empty((steps, rows, h_size), np.float32)
        kept = np.empty((steps, rows, 3 * h_size), np.float32) if keep else None
        h = np.zeros((rows, h_size), np.float32)
        for t in range(steps):
            a = inputs[x[t]]
            gates = h @ gate_rec
            gates += a[:, : 2 * h_size]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = (h * gates[:, h_size:]) @ new_rec
            new += a[:, 2 * h_size :]
            np.tanh(new, out=new)
            if keep:
                kept[t, :, : 2 * h_size], kept[t, :, 2 * h_size :] = gates, new
            new -= h
            new *= gates[:, :h_size]
            h = np.add(h, new, out=states[t])
            if valid is not None:
                h *= valid[t]
        return states, kept

    def positions(self, x: np.ndarray, valid: np.ndarray | None = None, keep: bool = False):
        """Distribution over the languages at every position of ``x`` (steps, rows).

        ``valid`` (steps, rows, 1) is 0 on padding, which follows a window's bytes.
        """
        states_f, kept_f = self._read(x, valid, "f", keep)
        states_b, kept_b = self._read(x[::-1], None if valid is None else valid[::-1], "b", keep)
        steps, rows = x.shape
        flat_f, flat_b = states_f.reshape(steps * rows, -1), states_b[::-1].reshape(steps * rows, -1)
        p = flat_f @ self.w["out_f"]
        p += flat_b @ self.w["out_b"]
        p += self.w["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p = p.reshape(steps, rows, -1)
        return (p, states_f, kept_f, states_b, kept_b) if keep else p

    def _back(self, x: np.ndarray, side: str, states: np.ndarray, kept: np.ndarray, d_states: np.ndarray, grads: dict) -> None:
        """Backpropagation through all steps of one direction."""
        n = self.hidden
        rec = self.w[f"rec_{side}"]
        steps, rows = x.shape
        d_rec = np.zeros_like(rec)
        d_in = np.empty((steps, rows, 3 * n), np.float32)
        carry = np.zeros((rows, n), np.float32)
        zero = np.zeros((rows, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h = states[t - 1] if t else zero
            update, reset, new = kept[t, :, :n], kept[t, :, n : 2 * n], kept[t, :, 2 * n :]
            d = d_states[t] + carry
            d_new = d * update * (1 - new * new)
            d_held = d_new @ rec[:, 2 * n :].T
            d_update = d * (new - h) * update * (1 - update)
            d_reset = d_held * h * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], axis=1)
            carry = d * (1 - update) + d_held * reset + d_gates @ rec[:, : 2 * n].T
            d_rec[:, : 2 * n] += h.T @ d_gates
            d_rec[:, 2 * n :] += (h * reset).T @ d_new
            d_in[t, :, : 2 * n], d_in[t, :, 2 * n :] = d_gates, d_new
        grads[f"rec_{side}"] = d_rec
        order = np.argsort(x.reshape(-1), kind="stable")
        sorted_x = x.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
        total = np.zeros_like(self.w[f"in_{side}"])
        total[sorted_x[first]] = np.add.reduceat(d_in.reshape(steps * rows, -1)[order], first, axis=0)
        grads[f"in_{side}"] = total

    def gradients(self, x: np.ndarray, label: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all valid positions, and its gradients."""
        p, states_f, kept_f, states_b, kept_b = self.positions(x, valid, keep=True)
        steps, rows = x.shape
        count = float(valid.sum())
        own = p[:, np.arange(rows), label]
        loss = float(-(np.log(np.maximum(own, 1e-9)) * valid[:, :, 0]).sum() / count)
        d = p.copy()
        d[:, np.arange(rows), label] -= 1
        d *= valid / count
        flat = d.reshape(steps * rows, -1)
        grads = {"bias": flat.sum(axis=0)}
        for side, states, kept in (("f", states_f, kept_f), ("b", states_b, kept_b)):
            aligned = states if side == "f" else states[::-1]
            grads[f"out_{side}"] = aligned.reshape(steps * rows, -1).T @ flat
            d_states = (flat @ self.w[f"out_{side}"].T).reshape(steps, rows, -1)
            if side == "f":
                self._back(x, side, states, kept, d_states, grads)
            else:
                self._back(x[::-1], side, states, kept, d_states[::-1], grads)
        return loss, grads

    def fit(self, x: np.ndarray, label: np.ndarray, valid: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> float:
        """Adam over shuffled batches of windows; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order = rng.permutation(x.shape[1])
            losses = []
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                one, grads = self.gradients(x[:, rows], label[rows], valid[:, rows])
                losses.append(one)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                shrink = min(1.0, 1.0 / (size + 1e-12))
                rate = RATE * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g * shrink
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    fixed = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                    self.w[k] -= (rate * fixed).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def windows(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts in windows: (steps, windows) bytes, each window's text, its length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    per = -(-lengths // steps)
    owner = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(steps, lengths[owner] - nth * steps)
    # every text filled up to whole windows: one copy of its bytes, nothing else grows with them
    filled = b"".join(part for t in texts for part in (t, bytes(-len(t) % steps)))
    return np.frombuffer(filled, np.uint8).reshape(len(owner), steps).T, owner, size


def _valid(size: np.ndarray, steps: int) -> np.ndarray | None:
    if len(size) and size.min() == steps:
        return None
    return (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)[:, :, None]


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text's distributions; zeros for an empty text."""
    x, owner, size = windows(texts)
    total = np.zeros((len(texts), network.classes))
    order = np.argsort(-size, kind="stable")  # full windows first
    for a in range(0, len(order), ROWS):
        rows = order[a : a + ROWS]
        longest = int(size[rows].max())
        valid = _valid(size[rows], longest)
        p = network.positions(np.ascontiguousarray(x[:longest, rows]), valid)
        if valid is not None:
            p *= valid
        np.add.at(total, owner[rows], p.sum(axis=0, dtype=np.float64))
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, steps: int = STEPS) -> DataFrame:
    """(lang, bytes): for every language one window of each of ``per_language`` documents.

    Above ``languages`` languages each has fewer, one at least, so that all have about ``per_language * languages`` together.
    Documents are picked by the hash of id and text, the window's place by another hash over the whole text.
    """
    labelled = docs.where("lang is not null and text is not null").where(F.length("text") > 0)
    raw = F.encode("text", "utf-8")
    latest = F.greatest(F.octet_length("text") - steps, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"), latest) + 1).cast("int")
    one = labelled.select("lang", F.xxhash64("doc_id", "text").alias("pick"), F.substring(raw, place, F.lit(steps)).alias("bytes"))
    known = labelled.select("lang").distinct().count()
    most = max(1, per_language * languages // max(known, languages))
    # first in blocks of a language, so that what its last ranking takes does not grow with the number of tasks
    blocks = one.withColumn("block", F.pmod("pick", F.lit(BLOCKS)))
    return topk(topk(blocks, ["lang", "block"], [F.col("pick")], most), ["lang"], [F.col("pick")], most).select("lang", "bytes", "pick")


def train(docs: DataFrame, **how) -> tuple[list[str], Network | None]:
    """Languages and network learnt from the labelled rows of ``docs``; no network without labels."""
    rows = sorted(training_windows(docs, **how).collect(), key=lambda r: (r["lang"], r["pick"]))  # PER_LANGUAGE * LANGUAGES, or one a language
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], None
    x, owner, size = windows([bytes(r["bytes"]) for r in rows])
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number[r["lang"]] for r in rows])[owner]
    network = Network(len(languages))
    valid = (np.arange(len(x))[:, None] < size[None, :]).astype(np.float32)[:, :, None]
    network.fit(x.astype(np.int64), label, valid)
    return languages, network


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score (both replaced if there).

    Needs text; other columns come back unchanged. Null and empty texts, texts without a
    letter, and every text if nothing was learnt are ``und`` with score 0. A text of any length is
    read whole, in windows of a fixed size; rows that repeat get the same result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast((languages, network))  # some thousand numbers
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = shared.value
        for batch in batches:
            found: list[str] = []
            score: list[float] = []
            for _, _, texts in slices(batch.column(at), HELD_CHARS):
                part = [t.encode() if net and any(map(str.isalpha, t)) else b"" for t in texts]
                p = pooled(net, part) if net else np.zeros((len(part), 1))
                best = p.argmax(axis=1)
                found += [names[k] if t else UNKNOWN for k, t in zip(best, part, strict=True)]
                score += [round(min(1.0, float(p[i, k])), 6) for i, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"]
            )

    schema = T.StructType(
        [*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are not learnt from."""
    return F.coalesce(crc_share(doc_id, 5) == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score, by a network learnt from its own rows with a lang that are not held out."""
    languages, network = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, languages, network)


@register("op3_byte_language")
def op3_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    languages, network = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), languages, network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
