"""Named queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}


def query(expected: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if expected is not None:
            EXPECTED[fn.__name__] = expected
        return fn

    return register
