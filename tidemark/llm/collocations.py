"""Phrases whose words stand together more often than their parts would by chance.

Two passes over the texts:

* the first one looks for phrases of one to five words that occur ``least`` times or more. Every
  occurrence belongs to a hash partition. Tasks hand on one summary of counters per partition and
  chunk of words; a partition merges its summaries into one Misra-Gries summary whose capacity
  exceeds its mass divided by ``least``. What such a summary loses of a counter is less than
  ``least``, so every frequent phrase survives, and infrequent ones may;
* the second pass counts the survivors exactly, words and not hashes. Tasks know the survivors by a
  Bloom filter of a fixed size; what it lets through by mistake is counted and falls out by its count.
  Counts travel to the hash partitions in compressed blocks, one of each chunk and partition.

Counters are keyed by 32 bits of a hash inside a partition. Phrases that share them are counted
together in the first pass, which can only add survivors.

As each part of a frequent phrase is frequent too, the second pass holds all that scores need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .common import ASCII_LOWER, ASCII_UPPER, documents
from .registry import register

LEAST = 100
MOST_WORDS = 5
COVER = 100
TOP = 2000
#: Ends a piece of text, and parts words inside one.
PIECE_END = r".,;:!?\x0A-\x0D"
BLANK = r"\x20\x09"
#: Occurrences that a hash partition of the first pass holds on average, at most.
PART_MASS = 16_000_000
#: Words that a task looks at together, and bytes of a text that are cut into words at once.
CHUNK_WORDS = 1_000_000
SLICE_BYTES = 1 << 20
#: Bits of the filter and bits set for each survivor.
FILTER_BITS = 1 << 27
PROBES = 4

#: Stands between pieces; no byte of UTF-8 text.
END = b"\xff"
_CUT = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_LOWER = bytes.maketrans(ASCII_UPPER.encode() + b".,;:!?\x0b\x0c\r", ASCII_LOWER.encode() + b"\n" * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words, with END for each end of a piece."""
    return data.translate(_LOWER).replace(b"\n", b" \xff ").split()


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in parts that end at a blank or at the end of a piece."""
    at = 0
    while len(data) - at > size and (cut := _CUT.search(data, at + size)):
        yield data[at : cut.end()]
        at = cut.end()
    yield data[at:]


class Chunk:
    """Words of many texts in one sequence, as codes into ``vocabulary``; ``starts`` of them may begin a phrase."""

    def __init__(self, words: list[bytes], runs: list[tuple[bytes, int]], starts: int):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        self.code = np.asarray(coded.indices).astype(np.int64)
        self.langs = sorted({lang for lang, _ in runs})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.repeat([place[lang] for lang, _ in runs], [n for _, n in runs]).astype(np.int64)
        self.word = self.code != (self.vocabulary.index(END) if END in self.vocabulary else -1)
        self.starts = starts

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the phrases of n words, n from 1 to ``most``."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], np.uint64)[self.code]
        salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)[self.lang]
        held, whole = (own ^ salt) * _MIX, self.word
        for n in range(1, most + 1):
            if n > 1:
                held = (held[:-1] * _MIX) ^ own[n - 1 :]
                held ^= held >> np.uint64(29)
                whole = whole[:-1] & self.word[n - 1 :]
            places = np.flatnonzero(whole[: self.starts])
            yield n, places, held[places]


def chunks(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[Chunk]:
    """The words of (lang, text as binary) rows; phrases that cross two chunks begin in the first one only."""
    words: list[bytes] = []
    runs: list[tuple[bytes, int]] = []
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in slices(text.as_py()):
                found = words_of(part)
                words += found
                runs.append((lang, len(found)))
                if len(words) >= size + most:
                    keep = most - 1
                    yield Chunk(words, runs, len(words) - keep)
                    words, runs = words[len(words) - keep :], _tail(runs, keep)
            words.append(END)
            runs.append((lang, 1))
    if words:
        yield Chunk(words, runs, len(words))


def _tail(runs: list[tuple[bytes, int]], n: int) -> list[tuple[bytes, int]]:
    out = []
    for lang, size in reversed(runs):
        if n <= 0:
            break
        out.append((lang, min(n, size)))
        n -= size
    return out[::-1]


def pack_counters(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending 32-bit keys and their counts, as compressed byte planes."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    squeeze = pa.Codec("zstd").compress
    planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, counts.astype("<u4"))]
    return tuple(squeeze(p, asbytes=True) for p in planes)


def unpack_counters(keys: bytes, counts: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    codec = pa.Codec("zstd")
    steps, counts = (
        np.frombuffer(codec.decompress(x, 4 * n, asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
        for x in (keys, counts)
    )
    return np.cumsum(steps, dtype=np.uint32), counts.astype(np.int64)


class Summary:
    """Misra-Gries counters of (key, count): a counter is short by ``lost`` at most, and ``lost`` < mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.lost = 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._rows = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._rows += len(keys)
        if self._rows > max(4 * self.capacity, 1 << 20):
            self.settle()

    def settle(self) -> None:
        """Add what waits and take the first count that has no room off all counters."""
        both = [(self.keys, self.counts), *self._waiting]
        keys, counts = (np.concatenate(x) for x in zip(*both, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            over = len(keys) - self.capacity - 1
            least = int(np.partition(counts, over)[over])
            self.lost += least
            kept = counts > least
            keys, counts = keys[kept], counts[kept] - least
        self.keys, self.counts, self._waiting, self._rows = keys, counts, [], 0

    def frequent(self, least: int) -> np.ndarray:
        """Keys that may stand ``least`` times or more; those that do are among them."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a key's bits in the filter."""
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            x = (keys + np.uint64(i + 1) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            yield ((x * _MIX) >> np.uint64(20)) % np.uint64(bits)


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.cast("binary").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """lang and n, its number of words."""
    own = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[^{BLANK}{PIECE_END}]+"))
    return docs.groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).agg(F.sum(own.cast("long")).alias("n"))


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper half, 32 bits of the hash in the lower one."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def surviving(docs: DataFrame, mass: int, least: int, most: int, part_mass: int, chunk: int) -> DataFrame:
    """First pass: the keys of all phrases that may stand ``least`` times or more."""
    parts = max(1, -(-mass // part_mass))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most, chunk):
            with np.errstate(over="ignore"):
                found = np.concatenate([_keys(h, parts) for _, _, h in part.phrases(most)])
            keys, counts = np.unique(found, return_counts=True)
            at = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            rows = [
                (p, *pack_counters(keys[a:b].astype(np.uint32), counts[a:b]), b - a, int(counts[a:b].sum()))
                for p, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                if b > a
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(SUMMARY.names, r, strict=True)) for r in rows], SUMMARY)

    def merge(group: pa.Table) -> pa.Table:
        held = Summary(sum(group["mass"].to_pylist()) // least + 1)
        for row in group.select(["keys", "counts", "n"]).to_pylist():
            held.merge(*unpack_counters(row["keys"], row["counts"], row["n"]))
        part = np.uint64(group["part"][0].as_py()) << np.uint64(32)
        return pa.table({"key": pa.array((held.frequent(least).astype(np.uint64) | part).view(np.int64))})

    summaries = _texts(docs).mapInArrow(summarise, "part long, keys binary, counts binary, n long, mass long")
    return summaries.groupBy("part").applyInArrow(merge, "key long")


SUMMARY = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("mass", pa.int64())])


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the keys, ``bits`` / 8 bytes however many there are. Spark sets the bits, segment by segment."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            set_ = np.concatenate(list(probes(own, bits))) if len(own) else own
            yield pa.RecordBatch.from_arrays([pa.array(set_.astype(np.int64) + 1)], ["bit"])

    rows = keys.mapInArrow(places, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("segment"))
    width = 1 << 15  # bits of one of Spark's bitmaps
    out = np.zeros((-(-bits // width), width // 8), np.uint8)
    for row in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("set")).collect():
        out[row["segment"] - 1] = np.frombuffer(row["set"], np.uint8)
    return out.ravel()


def counted(docs: DataFrame, keys: DataFrame, mass: int, least: int, most: int, part_mass: int, chunk: int, bits: int) -> DataFrame:
    """Second pass: lang, phrase, size (words) and f of all phrases that stand ``least`` times or more."""
    parts = max(1, -(-mass // part_mass))
    known = docs.sparkSession.sparkContext.broadcast(filter_of(keys, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for part in chunks(batches, most, chunk):
            before = np.full(len(part.code), -1)  # the phrase one word shorter that begins here, as a number
            with np.errstate(over="ignore"):
                for n, places, hashes in part.phrases(most):
                    own = _keys(hashes, parts)
                    there = before[places] >= 0 if n > 1 else np.ones(len(places), bool)
                    for bit in probes(own, bits):
                        there &= (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    places, own = places[there], own[there]
                    head = before[places] if n > 1 else part.lang[places]
                    _, first, number, times = np.unique(
                        head << 32 | part.code[places + n - 1], return_index=True, return_inverse=True, return_counts=True
                    )
                    before = np.full(len(part.code), -1)
                    before[places] = number
                    at = places[first]
                    spelt = [[part.vocabulary[c] for c in part.code[i : i + n].tolist()] for i in at.tolist()]
                    langs = pa.array([part.langs[i] for i in part.lang[at].tolist()], pa.binary())
                    phrases = pa.array([b" ".join(s) for s in spelt], pa.binary())
                    found = pa.table([langs, phrases, pa.array(np.full(len(at), n, np.int32)), pa.array(times.astype(np.int64))], schema=COUNTS)
                    yield _dealt(found, (own[first] >> np.uint64(32)).astype(np.int64))

    def merge(group: pa.Table) -> pa.Table:
        total, waiting, rows = COUNTS.empty_table(), [], 0
        for blob in [*group["counts"].to_pylist(), None]:
            if blob:
                waiting.append(pa.ipc.open_stream(blob).read_all())
                rows += len(waiting[-1])
            if not blob or rows > 1 << 20:
                both = pa.concat_tables([total, *waiting]).group_by(COUNTS.names[:3]).aggregate([("f", "sum")])
                total, waiting, rows = both.rename_columns(COUNTS.names).cast(COUNTS), [], 0
        return total.filter(pc.greater_equal(total["f"], least))

    blobs = _texts(docs).mapInArrow(count, "part long, counts binary")
    summed = blobs.groupBy("part").applyInArrow(merge, "lang binary, phrase binary, size int, f long")
    return summed.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase")})


COUNTS = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("size", pa.int32()), ("f", pa.int64())])


def _dealt(found: pa.Table, part: np.ndarray) -> pa.RecordBatch:
    """Counted phrases as one compressed block for each hash partition."""
    order = np.argsort(part, kind="stable")
    found, part = found.take(pa.array(order)), part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    blocks = []
    for a, b in pairwise(cuts):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, COUNTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(found.slice(a, b - a))
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blocks, pa.binary())], ["part", "counts"])


def _wide(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def scored(counts: DataFrame, totals: DataFrame, cover: int = COVER) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more that no longer one covers.

    A phrase is covered by a longer one that holds it and stands ``cover`` percent as often or more.
    It is enough to look at those one word longer, as any longer one holds such a one that stands at
    least as often.
    """
    words = F.split("phrase", " ")
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    known = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.call_function("div", _wide(F.lit(1000) * _wide("a") * _wide("n")).cast("decimal(38,0)"), _wide("l") * _wide("r"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    lowest = known.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(worst)
    ends = phrases.where("size > 2").select(
        "lang", "a", F.explode(F.array(*[F.array_join(F.slice("w", F.lit(b), F.col("size") - 1), " ") for b in (1, 2)])).alias("phrase")
    )
    longer = ends.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * cover))
    return alone.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


def mine(
    docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, cover: int = COVER,
    part_mass: int = PART_MASS, chunk: int = CHUNK_WORDS, bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two to ``most`` words that stands ``least`` times or more and is not covered.

    Needs text and lang; other columns are ignored. A null lang is ``und``, a null or empty text has no
    words, rows that repeat are counted as often as they stand there, an empty table gives an empty
    result. Texts of any length are read slice by slice. Scores of one phrase tie to the shorter first part.
    """
    totals = settle(word_totals(docs), "phrase-totals")
    mass = (totals.agg(F.sum("n")).first()[0] or 0) * most
    keys = settle(surviving(docs, mass, least, most, part_mass, chunk), "phrase-survivors")
    counts = settle(counted(docs, keys, mass, least, most, part_mass, chunk, bits), "phrase-counts")
    return scored(counts, totals, cover)


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each lang, by score, count and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    numbered = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return numbered.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


CHECK = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[{PIECE_END}]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^{BLANK}]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, {MOST_WORDS + 1}) AS s(k)),
f AS (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, size)) AS k FROM f WHERE size > 1),
x AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, lf.f AS l, rf.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (lf.f::HUGEINT * rf.f) AS score
      FROM c JOIN n USING (lang)
      JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(c.s[1:c.k], ' ')
      JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(c.s[c.k + 1:c.size], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT * FROM y WHERE NOT EXISTS (
        SELECT 1 FROM f o WHERE o.lang = y.lang AND o.size > y.size AND 100 * o.f >= {COVER} * y.a
        AND contains(' ' || o.phrase || ' ', ' ' || y.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM z QUALIFY rank <= {TOP}
"""


@register("op11_collocations", CHECK)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(mine(documents(spark, sf_dir)))
