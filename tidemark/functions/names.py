"""Name helpers: normalising, tokens, similarity, storage schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col_of

# Words that carry no search meaning.
STOP_WORDS = [
    "find", "show", "me", "search", "for", "the", "a", "an", "all", "get", "list", "discover",
    "about", "in", "of", "data", "tables", "table", "topic", "topics", "what", "whats",
    "is", "are", "give", "any", "assets",
]

# URI scheme prefix to storage kind.
STORAGE_BY_PREFIX = [
    ("ofs://", "ozone"), ("o3fs://", "ozone"),
    ("s3://", "s3"), ("s3a://", "s3a"), ("s3n://", "s3a"),
    ("adl://", "azure"), ("adls://", "azure"), ("abfs://", "azure"), ("wasb://", "azure"),
    ("gs://", "gcs"), ("gcs://", "gcs"),
    ("hdfs://", "hdfs"), ("/", "local"),
]


def squash(name) -> Column:
    """Lower case without '_' and '-': the form in which field names are compared."""
    return F.translate(F.lower(col_of(name)), "_-", "")


def column_safe(name) -> Column:
    """Lower case with '-' turned into '_': a usable column name."""
    return F.translate(F.lower(col_of(name)), "-", "_")


def last_part(name) -> Column:
    return F.substring_index(col_of(name), ".", -1)


def strip_topic_suffix(subject) -> Column:
    """Registry subject to topic: drop a trailing -value or -key."""
    return F.regexp_replace(col_of(subject), "-(value|key)$", "")


def tokens(text) -> Column:
    """Lower-case alphanumeric runs, split at letter/digit borders, length 2 or
    more, stop words removed, each token once."""
    spaced = F.regexp_replace(
        F.lower(col_of(text)), r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "
    )
    parts = F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    return F.array_except(parts, F.array(*[F.lit(w) for w in STOP_WORDS]))


def edit_similarity(a, b) -> Column:
    """1 - levenshtein / longer length; two empty names are equal."""
    a, b = col_of(a), col_of(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.lit(1.0) - F.try_divide(F.levenshtein(a, b), longest), F.lit(1.0))


def storage_kind(location, existing=None) -> Column:
    """Storage from the URI scheme; a value already set wins."""
    loc = col_of(location)
    ladder = F.lit(None).cast("string")
    for prefix, kind in reversed(STORAGE_BY_PREFIX):
        ladder = F.when(loc.startswith(prefix), kind).otherwise(ladder)
    if existing is None:
        return ladder
    return F.coalesce(F.nullif(col_of(existing), F.lit("")), ladder)
