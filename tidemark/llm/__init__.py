"""Operators of a training-data pipeline: filters, deduplication, search, scoring, mixing and packing.

Every module holds one operator, the query that applies it to its whole table and,
where SQL can express it, the check SQL. Nothing else in the library imports this
subpackage.
"""

from . import (  # noqa: F401  each module registers its query
    ann_forest,
    collocations,
    hard_negatives,
    hash_tree,
    lattice_lm,
    line_rules,
    mixing,
    packing,
    pii,
    byte_language,
    simhash_vp,
    token_counts,
    url_model,
)
from .registry import CHECK_SQL, QUERIES  # noqa: F401
