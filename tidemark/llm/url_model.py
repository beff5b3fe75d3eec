"""URL filters: rules by host and path, and a character language model for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs,
are learnt from the URLs that the rules decide. A URL's score is the difference of its
log-likelihoods per character; the threshold is calibrated on decided URLs that were not
learnt from. Characters fall into 40 classes, so a model is at most 40^4 counts whatever
the number of URLs: that bounds what is collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_share, lower_ascii
from .registry import register

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 3
SIGNS = "/.-_?=&%#:~+@"
CLASSES = 40  # letters, one for digits, signs, one for other bytes below and one above 127, the margin
EDGE = CLASSES - 1
#: Decided URLs whose crc32 modulo this is 0 calibrate the threshold, the others are learnt from.
CALIBRATE = 5
#: Scores are counted in bins of this width when the threshold is chosen.
BIN, BINS = 0.01, 1000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(whole, F.lit("://")), F.substring_index(whole, "://", 1)).otherwise(F.lit(None))
    after = F.substring(whole, F.length(rest) + 4, F.length(whole))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"(?s)^/[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(lower_ascii(host), empty), F.coalesce(path, empty)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null. A rule fits its host, all subdomains, and paths that start with its own."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        here = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        fits = F.when(here, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 3, np.int64)
    table[128:] = CLASSES - 2
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = table[ord(c.upper())] = i
    table[ord("0") : ord("9") + 1] = 26
    for i, c in enumerate(SIGNS):
        table[ord(c)] = min(27 + i, CLASSES - 4)
    return table


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of ORDER + 1 classes of each URL between margins, and each URL's first place in them.

    Every character and the end of the URL is the last of one window.
    """
    table = _class_table()
    texts = [(u or "").encode() for u in urls.to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = table[np.frombuffer(b"".join(texts), np.uint8)]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    padded = np.full(int(first[-1]) + ORDER * len(texts), EDGE, np.int64)
    shift = np.repeat(np.arange(len(texts)) * (ORDER + 1) + ORDER, lengths)
    padded[np.arange(len(joined)) + shift] = joined
    codes = np.zeros(max(0, len(padded) - ORDER), np.int64)
    for k in range(ORDER + 1):
        codes = codes * CLASSES + padded[k : len(padded) - ORDER + k]
    # windows that begin inside one URL's stretch and end in the next one's are not wanted
    begin = np.arange(len(texts)) * ORDER + first[:-1]
    keep = np.repeat(begin - first[:-1], np.diff(first)) + np.arange(int(first[-1]))
    return codes[keep], first[:-1]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(accepted, gram, n) over all rows of (url, accepted); tasks send each gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, np.ndarray] = {}
        for batch in batches:
            flags = np.asarray(batch.column(1).to_pylist(), bool)
            for flag in (False, True):
                codes, _ = grams(batch.column(0).filter(pa.array(flags == flag)))
                if len(codes):
                    held.setdefault(flag, np.zeros(CLASSES ** (ORDER + 1), np.int32))
                    held[flag] += np.bincount(codes, minlength=CLASSES ** (ORDER + 1)).astype(np.int32)
        for flag, n in held.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), flag)), pa.array(used), pa.array(n[used].astype(np.int64))], ["accepted", "gram", "n"]
            )

    counted = labelled.select("url", "accepted").mapInArrow(run, "accepted boolean, gram bigint, n bigint")
    return counted.groupBy("accepted", "gram").agg(F.sum("n").alias("n"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each window's last class given the classes before it.

    Witten-Bell interpolation: the estimate after k classes is mixed with that after k - 1 by the number
    of different classes that followed the context, so a context never seen falls back to a shorter one.
    """
    full = counts.reshape((CLASSES,) * (ORDER + 1)).astype(np.float64)
    p = np.full(CLASSES, 1 / CLASSES)
    for k in range(ORDER + 1):
        n = full.sum(axis=tuple(range(ORDER - k))) if k < ORDER else full
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        seen = n.sum(axis=-1, keepdims=True)
        mixed = (n + kinds * p) / np.maximum(seen + kinds, 1)
        p = np.where(seen > 0, mixed, np.broadcast_to(p, n.shape))
    return np.log(p).reshape(-1)


def with_scores(pages: DataFrame, ratio) -> DataFrame:
    """``pages`` (url and others) with the column score: mean log ratio per character and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            codes, first = grams(batch.column(at))
            if batch.num_rows:
                sums = np.add.reduceat(table[codes].astype(np.float64), first)
                found = sums / np.diff(np.append(first, len(codes)))
            else:
                found = np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    at = pages.columns.index("url")
    return pages.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.schema)}, score double")


def threshold(histogram: list[tuple[int, bool, int]]) -> float:
    """The score that best parts accepted from rejected URLs, both weighing the same: the middle of the best stretch.

    ``histogram`` has (bin, accepted, rows). 0 if either kind is missing.
    """
    n = np.zeros((2, BINS))
    for b, accepted, rows in histogram:
        n[int(accepted), b] += rows
    if not n.sum(axis=1).all():
        return 0.0
    n /= n.sum(axis=1, keepdims=True)
    errors = np.concatenate([[0], np.cumsum(n[1])]) + np.concatenate([[0], np.cumsum(n[0][::-1])])[::-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    middle = best[np.argmin(np.abs(best - best.mean()))]
    return float((middle - BINS // 2) * BIN)


def classify(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score, one row per row of ``pages``.

    Needs page_id and url; other columns are ignored. A null or empty URL has no host, no
    path and no rule, and is scored as an empty one; rows that repeat are learnt from as
    often as they stand there; without decided URLs of both kinds every score is 0 and the verdict allow;
    an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = split.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("fit"))
    labelled = judged.where("fit is not null").select(
        "url", (F.col("fit.verdict") == "allow").alias("accepted"), (crc_share(F.col("url"), CALIBRATE) == 0).alias("calibrates")
    )
    n = {}
    for flag in (False, True):
        n[flag] = np.zeros(CLASSES ** (ORDER + 1), np.int64)
    for row in gram_counts(labelled.where(~F.col("calibrates"))).toLocalIterator():  # 2 * 40^4 rows at most
        n[row["accepted"]][row["gram"]] = row["n"]
    both = n[False].any() and n[True].any()
    table = (log_model(n[True]) - log_model(n[False])).astype(np.float32) if both else np.zeros(CLASSES ** (ORDER + 1), np.float32)
    ratio = spark.sparkContext.broadcast(table)  # 40^4 numbers, 10 MB
    limit = 0.0
    if both:
        place = F.least(F.greatest(F.floor(F.col("score") / BIN) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
        seen = with_scores(labelled.where("calibrates").select("url", "accepted"), ratio)
        limit = threshold([tuple(r) for r in seen.groupBy(place.alias("bin"), "accepted").count().collect()])  # 2 rows a bin at most
    flat = judged.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    own = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return with_scores(flat, ratio).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


@register("op2_url_verdicts")
def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/pages.parquet"))
