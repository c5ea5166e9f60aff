"""The registry of queries: each is a function of (spark, folder of tables), most have their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q6(x: str) -> str:
    """SQL of a number rounded to six places the way both engines agree on."""
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
