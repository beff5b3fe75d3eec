"""Quality rules: base counts of a text and lines that many documents of one host share.

A line is normalised (lower case, digits to one 0, white space to one space), hashed
together with its host, and counted once for each distinct document that holds it. Lines of
``max_docs`` documents or more are boilerplate and removed; a document that loses more than
``max_lost`` percent of its words with them, or has fewer than ``MIN_WORDS`` left, is depleted and rejected.
``judge`` gives the counts and the verdict, ``clean`` the documents without those lines, also judged by the repeats in what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle

from .common import WORD, documents, let, word_count, words
from .registry import register

MAX_DOCS = 25
MAX_LOST = 70
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def text_lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(WORD))


def normal_line(line: Column) -> Column:
    spaced = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")
    return F.regexp_replace(F.trim(spaced), "[0-9]+", "0")


def line_key(host: Column, line: Column) -> Column:
    """One number for a line of a host; a null host is a host of its own."""
    return F.xxhash64(F.isnull(host), host, normal_line(line))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that stand at two or more places of the text."""

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))

        def places(held: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(held, i - 1)["key"] == x["key"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(held, i + 1)["key"] == x["key"], F.lit(False))

            return F.array_sort(F.transform(F.filter(held, twin), lambda x: x["at"].cast("long")))

        return F.aggregate(
            let(placed, places),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("long").alias("last")),
            lambda held, at: F.struct(
                (held["n"] + F.least(F.lit(window).cast("long"), at - held["last"])).alias("n"), at.alias("last")
            ),
            lambda held: held["n"],
        )

    def count(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
        return F.when(
            F.size(w) >= window,
            let(
                keys,
                lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("long")),
            ),
        ).otherwise(F.lit(0).cast("long"))

    return let(found, count)


def base_counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text as one struct."""
    lines = let(text_lines(text), lambda held: (F.size(held) - F.size(F.array_distinct(held))).cast("long"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            lines.alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``line``: keys of the lines that ``max_docs`` or more documents of one host hold.

    A document counts once for a line, however often it holds the line or stands in the table; documents without an
    id are told apart by their texts. Pairs of line and document are dealt by both, so a line of every
    document is spread, and counts are combined in each task before they move.
    """
    lines = F.array_distinct(F.transform(text_lines(F.col("text")), lambda x: line_key(F.col("source"), x)))
    own = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    held = docs.select("doc_id", own.alias("own"), F.explode(lines).alias("line")).distinct()
    return held.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= max_docs).select("line")


def placed_lines(text: Column) -> Column:
    """The lines of a text that have a word, each with its place among all lines."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, at: F.struct(x.alias("line"), at.alias("at")))
    return F.filter(every, lambda x: x["line"].rlike(WORD))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines at the places ``gone``; all other lines stay as they are and in order."""

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda at: F.get(lines, at)), "\n")

    return F.when(F.size(gone) == 0, text).otherwise(let(F.split(text, "\n", -1), rest))


def losses(docs: DataFrame, carried: list[str], max_docs: int) -> DataFrame:
    """``doc`` (the ``carried`` columns), ``base``, ``n_frequent_words`` and ``gone`` (places of frequent lines), one row per row of ``docs``.

    The frequent lines are stored once, so Spark knows their size: it broadcasts them
    below its own threshold, else both sides of the join are shuffled and AQE splits the
    partition of a hot line. Counts and carried columns travel with the first entry of a document only.
    """
    frequent = settle(frequent_lines(docs, max_docs), "frequent-lines").withColumn("frequent", F.lit(True))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
        base_counts(F.col("text")).alias("base"),
        F.transform(
            placed_lines(F.col("text")),
            lambda x: F.struct(line_key(F.col("source"), x["line"]).alias("line"), word_count(x["line"]).alias("words"), x["at"].alias("at")),
        ).alias("lines"),
    )
    head = F.struct(F.col("doc"), F.col("base"))
    none = F.lit(None).cast(rows.select(head.alias("h")).schema["h"].dataType)
    first = F.struct(
        F.xxhash64("row").alias("line"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("int").alias("at"), head.alias("head")
    )
    entries = F.concat(
        F.array(first),
        F.transform(
            F.col("lines"), lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), x["at"].alias("at"), none.alias("head"))
        ),
    )
    return (
        rows.select("row", F.explode(entries).alias("e"))
        .select("row", "e.line", "e.words", "e.at", "e.head")
        .join(frequent, "line", "left")
        .groupBy("row")
        .agg(
            F.first("head", ignorenulls=True).alias("head"),
            F.coalesce(F.sum(F.when(F.col("frequent"), F.col("words"))), F.lit(0)).alias("n_frequent_words"),
            F.collect_list(F.when(F.col("frequent"), F.col("at"))).alias("gone"),
        )
        .select("head.doc", "head.base", "n_frequent_words", "gone")
    )


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    """True where the base rules reject a text."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """Base counts, words lost with frequent lines, words left without them, and the verdict, one row per row of ``docs``.

    Needs doc_id, text and source; other columns are ignored. A null text has no words
    and fails the base rule; a null source is a host of its own; rows of one doc_id are judged
    each and count as one document of a line; an empty table gives an empty result.
    """
    lost = losses(docs.select("doc_id", "text", "source"), ["doc_id"], max_docs).select("doc.doc_id", "base.*", "n_frequent_words")
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (100 * F.col("n_frequent_words") > max_lost * F.col("n_words")) | (left < MIN_WORDS)
    return lost.withColumns({"n_words_left": left, "base_failed": failed, "kept": ~failed & ~depleted})


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with their frequent lines removed from text, and n_words_left and kept (both replaced if there).

    Rows, other columns and the remaining lines stay as they are. A document is kept if its
    whole text and what is left of it pass the base rules and it lost no more than ``max_lost`` percent of its words.
    """
    others = [c for c in docs.columns if c not in ("n_words_left", "kept")]
    rest = losses(docs, others, max_docs).withColumn("left", without(F.col("doc.text"), F.col("gone")))
    counted = rest.withColumn("now", base_counts(F.col("left")))
    words, left = F.col("base.n_words"), F.col("now.n_words")
    failed = fails(words, F.col("base.n_repeat_words")) | fails(left, F.col("now.n_repeat_words"))
    return counted.select(
        *[F.col("left").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in others],
        left.alias("n_words_left"),
        (~failed & ~(100 * (words - left) > max_lost * words)).alias("kept"),
    )


CHECK = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
tok AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS k
        FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM tok WHERE len(w) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS at FROM twice) GROUP BY r),
raw AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, source, line,
                 regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
often AS (SELECT source, k FROM (SELECT DISTINCT coalesce('i' || doc_id, 't' || md5(text)) AS doc, lines.source, k FROM lines JOIN d USING (r))
          GROUP BY source, k HAVING count(*) >= {MAX_DOCS}),
lost AS (SELECT l.r, sum(l.n) AS n FROM lines l JOIN often o ON l.k = o.k AND l.source IS NOT DISTINCT FROM o.source GROUP BY l.r),
base AS (SELECT d.r, d.doc_id, len(tok.w) AS n_words, length(array_to_string(tok.w, '')) AS word_chars,
                len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                coalesce(lost.n, 0) AS n_frequent_words
         FROM d JOIN tok USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words, n_words - n_frequent_words AS n_words_left,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
           AND NOT (100 * n_frequent_words > {MAX_LOST} * n_words) AND n_words - n_frequent_words >= {MIN_WORDS} AS kept
FROM base
"""


@register("op1_line_rules", CHECK)
def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
