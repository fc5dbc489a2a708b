from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emporia.functions.numbers import py_round

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a (spark, folder) → DataFrame function under a name, with its SQL if there is one."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double, so that the order of float sums does not show."""
    doubles = {c: py_round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as `|`-joined text."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def r(expression: str, digits: int = 4) -> str:
    """SQL for `py_round`."""
    return f"(cast(format('{{:.{digits}f}}', cast({expression} as double)) as double) + 0.0)"
