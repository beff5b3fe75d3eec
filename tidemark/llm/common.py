"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Elements added one by one before the sums of whole blocks are added.
BLOCK = 128


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for the row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def crc_share(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def _running(values: Column) -> Column:
    grown = F.aggregate(
        values,
        F.array(F.lit(0).cast("long")),
        lambda held, x: F.concat(held, F.array(F.element_at(held, -1) + x)),
    )
    return F.slice(grown, F.lit(2), F.size(values))


def running_total(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs.

    Blocks are summed on their own and shifted by the totals of the blocks
    before them, so a long array costs about its length times the block size.
    """

    def of(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
            lambda b: _running(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            blocks,
            lambda inner: let(
                _running(F.transform(inner, lambda block: F.element_at(block, -1))),
                lambda ends: F.flatten(
                    F.transform(
                        inner,
                        lambda block, b: F.transform(
                            block, lambda x: x + F.when(b > 0, F.element_at(ends, F.greatest(b, F.lit(1)))).otherwise(0)
                        ),
                    )
                ),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(empty))
