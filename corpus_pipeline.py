"""A training-data pipeline over the documents table: five stages, each one operator of ``tidemark.llm``.

Every stage reads all that its predecessor kept and returns the columns of documents; the last one
returns packed pieces. Stages are written as Parquet and read again, so each is planned on its own
input and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_language, common, mixing, packing, pii, simhash_vp
from tidemark.session import settle

#: Documents whose language is less sure are rejected, as are those without letters.
LEAST_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which is written to their lang.

    Null texts, texts without a letter and those whose language is not sure go; if no row has a lang to
    learn from, all go. Given columns stay as they are, also those that are called lang_pred or score.
    """
    aside = {c: f"given_{i}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score")}
    found = byte_language.identify(docs.withColumnsRenamed(aside))
    sure = found.where((F.col("lang_pred") != byte_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    own = {"lang": F.col("lang_pred")} | {c: F.col(name) for c, name in aside.items()}
    return sure.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with all its columns; null and empty texts are one group."""
    return simhash_vp.first_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for, the last one of a source cut; those of no words go."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids in place of documents; of their columns, doc_id stays."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_to_weights),
    ("pack", pack_sequences),
]

#: The network, the fingerprints and the tokens cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
