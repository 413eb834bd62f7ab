"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, which must be new."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def dround(expr: str, places: int) -> str:
    """SQL that rounds a double by its exact binary value, ties to even, as functions.numbers.rounded does."""
    return f"(CAST(printf('%.{places}f', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"
