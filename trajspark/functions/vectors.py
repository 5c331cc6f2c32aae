"""Vector expressions. Three-component vectors stay scalar columns so they compile into codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def parts(col: Column | str, n: int = 3) -> list[Column]:
    col = F.col(col) if isinstance(col, str) else col
    return [col[i] for i in range(n)]


def dot(x: Sequence[Column], y: Sequence[Column]) -> Column:
    total = x[0] * y[0]
    for a, b in zip(x[1:], y[1:]):
        total = total + a * b
    return total


def norm(x: Sequence[Column]) -> Column:
    return F.sqrt(dot(x, x))


def is_finite(x: Column) -> Column:
    """False for NaN, both infinities and NULL (NaN compares above infinity in Spark)."""
    return F.coalesce((x < F.lit(INF)) & (x > F.lit(-INF)), F.lit(False))


def array_sub(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def array_dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def array_norm(x: Column) -> Column:
    return F.sqrt(array_dot(x, x))


def first_two_columns(r: Column) -> Column:
    """Row-major nine-number rotation -> its first two columns, still row-major."""
    return F.array(r[0], r[1], r[3], r[4], r[6], r[7])
