"""Registered queries: each plan wires operators to the given tables."""

from importlib import import_module

_PLANS = ["orders", "quality", "catalog", "search", "lineage_many", "governance", "vectors", "health", "kpi", "sources", "streams"]


def load_all() -> None:
    for name in _PLANS:
        import_module(f"tidemark.plans.{name}")
