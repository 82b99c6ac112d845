"""One registry: query name -> callable, and query name -> SQL twin for DuckDB where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            # rows in order: DuckDB does not end when it streams rows out of a join on a materialised part into a LIMIT
            ORACLES[name] = f"SELECT * FROM ({sql}) ORDER BY ALL"
        return f

    return register
