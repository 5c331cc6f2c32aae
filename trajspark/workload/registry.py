"""Registered queries: a Spark callable per name and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0, NaN becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def q6(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT isnan({expr}) THEN round({expr}, {digits}) + 0.0 END"
