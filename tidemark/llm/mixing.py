"""Mixing sources to target weights.

Every source is ordered by a hash-random key, its word counts are summed along that
order, and the mix takes the order from its start, again and again, until the source's
budget is used up to the word. The sums are distributed: keys are uniform, so ranges of
them hold about equally many documents, each range is summed on its own and shifted by
the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle

from .common import documents, word_count
from .registry import register

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"
#: Documents that one range of keys holds on average.
RANGE_ROWS = 50_000
KEY_BITS = 60


def random_key(seed: str = SEED) -> Column:
    """60 uniform bits from the document's id, or from its text where it has no id."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, n_docs and target from rows of (source, size).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``limit`` times its source's words and
    the excess goes to the others by weight. That fixed point is found at once: with the
    sources in order of limit over weight, the first ones are full, and the rest divide
    what is left. One row a source is sorted here, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = (
        totals.withColumn("place", F.row_number().over(listed) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size").cast("double") * limit)
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = capped.select(
        "*",
        F.coalesce(F.sum("most").over(above), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(onward).alias("weight_left"),
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("budget"),
    )
    level = (F.col("budget") - F.col("filled")) / F.col("weight_left")
    open_ones = levels.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), "place", "level")))
    cut = open_ones.withColumn("cut", first.over(Window.partitionBy()))
    target = F.when(
        F.col("cut").isNotNull() & (F.struct(F.col("most") / F.col("weight"), "place") >= F.struct("cut.ratio", "cut.place")),
        F.least(F.col("cut.level") * F.col("weight"), F.col("most")),
    ).otherwise(F.col("most"))
    return cut.select("source", "source_size", "n_docs", target.alias("target"))


def take(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """Words that the mix takes of each document.

    Needs doc_id, text and source; further columns come back unchanged unless they are
    called size, source_size, target or taken, which are replaced. Null texts have size 0 and
    give nothing; a null source is a source of its own; rows that repeat have one key and
    stand side by side in the order; an empty table gives an empty result.

    The document on the cut gives the first words of itself, so a source's taken words
    equal its target rounded down.
    """
    given = docs.drop("size", "source_size", "target", "taken")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("row"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        random_key(seed).alias("mix_key"),
    )
    return _taken(rows, weights, share, limit).select("row.*", "size", "source_size", "target", "taken")


def source_key() -> Column:
    """A source as a join key that is never null."""
    return F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))


def _placed(rows: DataFrame, weights: tuple, share: float, limit: int) -> DataFrame:
    """Rows of (doc_id, source, size, mix_key, ...) with src, source_size, target, the number of ``whole`` passes
    over their source, and the ``part`` of their words that the last pass takes."""
    source = source_key()
    targets = settle(source_targets(rows.select("source", "size"), weights, share, limit), "mix-targets").select(
        source.alias("src"), "source_size", "target", F.ceil(F.col("n_docs") / RANGE_ROWS).alias("ranges")
    )
    ranged = (
        rows.withColumn("src", source)
        .join(targets, "src")
        .withColumn("key_range", F.floor(F.col("mix_key") / F.lit(float(2**KEY_BITS)) * F.col("ranges")))
    )
    sums = ranged.groupBy("src", "key_range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("src").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "key_range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = (
        Window.partitionBy("src", "key_range")
        .orderBy("mix_key", "size", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.join(starts, ["src", "key_range"]).withColumn(
        "start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    none = F.lit(0).cast("long")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(none)
    rest = budget - F.col("whole") * F.col("source_size")
    part = F.greatest(none, F.least(F.col("size"), rest - F.col("start")))
    return placed.withColumn("whole", whole).withColumn("part", part)


def _taken(rows: DataFrame, weights: tuple, share: float, limit: int) -> DataFrame:
    """From (row, doc_id, source, size, mix_key) to (row, size, source_size, target, taken)."""
    taken = F.col("whole") * F.col("size") + F.col("part")
    return _placed(rows, weights, share, limit).select("row", "size", "source_size", "target", taken.alias("taken"))


def source_cuts(places: DataFrame) -> DataFrame:
    """src, whole, the place (mix_key, size, doc_id) at which the last pass ends (null: nowhere) and the words
    it takes of the rows at that place; one row a source."""
    place = F.struct("mix_key", "size", "doc_id")
    ends = places.groupBy("src").agg(F.max("whole").alias("whole"), F.min(F.when(F.col("part") < F.col("size"), place)).alias("cut"))
    ends = settle(ends, "mix-ends")
    there = places.join(ends.select("src", "cut"), "src").where(place == F.col("cut"))
    return ends.join(there.groupBy("src").agg(F.sum("part").alias("words")), "src", "left")


def first_words(text: Column, n: Column) -> Column:
    """The start of a text up to its ``n``-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole documents as often as they are taken
    whole, then the first words of the document on the cut. Documents of no words give no row.

    Only sizes and keys are ordered. They yield the place of the cut in each source, one row a
    source, and every document tells from its own place what is taken of it, so texts are not
    shuffled. Rows that repeat share a place; those on a cut are stored and ranked by number.
    """
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        "source",
        word_count(F.col("text")).alias("size"),
        random_key(seed).alias("mix_key"),
        F.xxhash64("doc_id", "text").alias("doc_id"),
    )
    narrow = settle(keyed.drop("doc"), "mix-sizes")
    places = settle(_placed(narrow, weights, share, limit).select("src", "mix_key", "size", "doc_id", "whole", "part"), "mix-places")
    rows = (
        keyed.where(F.col("size") > 0)
        .select("doc", "size", F.struct("mix_key", "size", "doc_id").alias("place"), source_key().alias("src"))
        .join(settle(source_cuts(places), "mix-cuts"), "src")
    )

    on_cut = rows.where(F.col("place") == F.col("cut")).withColumn("number", F.monotonically_increasing_id())
    on_cut = settle(on_cut.select("doc", "size", "src", "whole", "words", "number"), "mix-on-cut")
    own = Window.partitionBy("src", "block").orderBy("number")
    numbers = on_cut.select("src", "number", F.floor(F.col("number") / RANGE_ROWS).alias("block"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = numbers.groupBy("src", "block").count().select("src", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranks = numbers.join(firsts, ["src", "block"]).select("number", (F.col("first") + F.row_number().over(own) - 1).alias("rank"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("words") - F.col("rank") * F.col("size")))
    ending = on_cut.join(settle(ranks, "mix-ranks"), "number").select("doc", "size", "whole", last.alias("last"))

    full = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    others = rows.where(F.col("cut").isNull() | (F.col("place") != F.col("cut"))).select(
        "doc", "size", "whole", F.when(full, F.col("size")).otherwise(F.lit(0).cast("long")).alias("last")
    )
    copies = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.array(F.col("last")))
    taken = others.unionByName(ending).select("doc", "size", F.explode(F.filter(copies, lambda n: n > 0)).alias("n"))
    text = F.when(F.col("n") < F.col("size"), first_words(F.col("doc.text"), F.col("n"))).otherwise(F.col("doc.text"))
    cut = {"text": text}
    if "n_chars" in names:
        cut["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return taken.select(*[cut.get(c, F.col("doc").getField(c)).alias(c) for c in names])


CHECK = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, {KEY_BITS // 4}))::BIGINT AS k
           FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS w, 2 * s AS most FROM s),
l AS (SELECT *, ({SHARE} * sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY most / w, place) AS pos FROM w),
c AS (SELECT *, min(CASE WHEN level * w < most THEN pos END) OVER () AS cut FROM l),
v AS (SELECT source, s, CASE WHEN pos >= cut THEN least(most, w * max(CASE WHEN pos = cut THEN level END) OVER ()) ELSE most END AS target FROM c),
p AS (SELECT d.doc_id, d.size, v.s::BIGINT AS source_size, v.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM q
"""


@register("op7_mix_sources", CHECK)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), random_key().alias("mix_key")
    )
    rows = settle(rows, "mix-sizes").withColumn("row", F.struct("doc_id"))
    return _taken(rows, WEIGHTS, SHARE, LIMIT).select("row.*", "size", "source_size", "target", "taken")
