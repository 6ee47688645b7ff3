"""Every operator over the given tables, each with the SQL that has to agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can say it."""
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql.strip()
        return query

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from cellfold.checks import arrays, catalogs, pictures, series, texts  # noqa: F401

    return QUERIES, SQL
