"""Where plans register a query and, where SQL can state it, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
CHECK_SQL: dict[str, str] = {}


def as_bigint(sql: str, *cols: str) -> str:
    """The check SQL with the sums of integers as BIGINT, the type Spark gives them."""
    swaps = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            CHECK_SQL[key] = sql
        return fn

    return register
