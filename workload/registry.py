"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}


def query(expected: str | None = None):
    """Register a query under its function name, with its SQL when SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if expected is not None:
            EXPECTED[fn.__name__] = expected
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def r6(expression: str, alias: str | None = None) -> str:
    """The same rounding in SQL; adding zero removes a negative zero."""
    return f"round({expression}, 6) + CAST(0 AS DOUBLE) AS {alias or expression.split('.')[-1]}"
