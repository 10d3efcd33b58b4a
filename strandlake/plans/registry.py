"""Every query of the engine by name, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import file_queries, registry_queries, sequence_queries  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
