"""The list of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name (less a final ``_``), with the SQL of its result."""

    def register(function: Query) -> Query:
        name = function.__name__.rstrip("_")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
