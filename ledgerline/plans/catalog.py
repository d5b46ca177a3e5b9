"""Named queries: each key maps to a Spark plan ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, an independent DuckDB oracle over the same
input tables. Every query reads the whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query under ``name`` (and its oracle SQL if given)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = ["q_scoring", "q_review", "q_audit", "q_registry", "q_text", "q_retrieval", "q_stream"]
