"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    """Register ``run(spark, folder)``; ``sql`` is its DuckDB text."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run

    return register
