"""Where queries are registered, with their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonewright.plans.geography import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(ctes: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name, with its SQL after the named common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_ctes(ctes, sql, recursive)
        return f

    return add
