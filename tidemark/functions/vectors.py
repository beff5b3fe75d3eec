"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col_of


def dot(a, b) -> Column:
    products = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for an empty or all-zero vector, null for different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))
    return F.when(F.size(col_of(a)) == F.size(col_of(b)), value)
