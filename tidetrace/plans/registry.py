"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a query builder under ``key`` with its oracle SQL (if SQL can say it)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tidetrace.plans import (  # noqa: F401
        trace_queries, prepare_queries, eval_queries, stance_queries, cluster_queries,
        io_queries,  # noqa: F401 (imports trace, cluster and eval queries first)
    )
