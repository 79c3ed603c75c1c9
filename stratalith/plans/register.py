"""The tables of registered queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def count_sql(c: str, patterns: list[str]) -> str:
    """How often any of the patterns matches, each for itself, in SQL."""
    return " + ".join(f"len(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}'))" for p in patterns)
