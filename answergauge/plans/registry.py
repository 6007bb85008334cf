"""A query is a function of (session, table folder) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def collector() -> tuple[dict[str, Query], Callable]:
    """A dict of queries and the decorator that fills it."""
    queries: dict[str, Query] = {}

    def query(sql: str | None = None) -> Callable:
        def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
            queries[fn.__name__] = Query(fn, sql)
            return fn

        return register

    return queries, query
