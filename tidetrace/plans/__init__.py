"""Registered queries: each pairs a Spark builder with an equivalent DuckDB SQL text."""

from tidetrace.plans.registry import QUERIES, ORACLE_SQL, load_all  # noqa: F401
