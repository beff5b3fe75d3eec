"""Uniform samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits by which hashes are counted in one pass: 4,096 counts come back.
STEP = 3
#: Rows on the border of a sample that one task may rank, and digits after which only repeated rows are left there.
BORDER_ROWS = 100_000
DIGITS = 9
#: Copies of one row made at once.
COPIES = 10_000


def exact_sample(df: DataFrame, k: int, key: Column | None = None) -> DataFrame:
    """Exactly min(k, rows) rows: those of the smallest md5 of ``key``, then of the whole row.

    The same rows for any partitioning and on every run; without a ``key`` the row alone decides. The border
    is found from counts by the first digits of the hash, a pass over the rows for each three digits until few
    rows share them; rows below it are filtered where they lie and only those on it are ranked, repeated
    rows as one with a count. Null keys hash like an empty text; an empty table or k = 0 gives no rows.
    """
    if k < 0:
        raise ValueError("the size of a sample cannot be negative")
    whole = F.md5(F.to_json(F.struct("*")))
    place = whole if key is None else F.concat(F.md5(F.coalesce(key.cast("string"), F.lit(""))), whole)
    hashed = df.select(F.struct("*").alias("row"), place.alias("place"))
    found = _border(hashed, k)
    if found is None:
        return df
    border, left = found
    below = hashed.where(F.col("place") < border).select("row.*")
    return below.unionByName(_first(hashed.where(F.col("place").startswith(border)), left))


def _border(hashed: DataFrame, k: int) -> tuple[str, int] | None:
    """First digits of the k-th smallest hash and how many rows with them belong to the sample; None if all rows do."""
    border, left = "", k
    while len(border) < DIGITS:
        digits = F.substring("place", 1, len(border) + STEP).alias("digits")
        counts = hashed.where(F.col("place").startswith(border)).groupBy(digits).count().orderBy("digits").collect()
        for digits, n in counts:
            if n >= left:
                border = digits
                break
            left -= n
        else:
            return None
        if n <= BORDER_ROWS:
            break
    return border, left


def _first(hashed: DataFrame, k: int) -> DataFrame:
    """The first k rows by hash; repeated rows are counted, ranked as one and written out again."""
    counted = hashed.groupBy("place").agg(F.any_value("row").alias("row"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counted.withColumn("take", F.least(F.col("n"), F.lit(k) - before)).where(F.col("take") > 0)
    blocks = taken.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("take") - 1, F.lit(COPIES).cast("long"))))
    return blocks.select("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("take") - F.col("at"))))).select("row.*")
