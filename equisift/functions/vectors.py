"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(v: str | Column) -> Column:
    """v over its length; a zero vector stays as it is, so its cosine with anything is 0."""
    v = F.col(v) if isinstance(v, str) else v
    length = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    # Bound by a lambda of its own, or the length would be made again for each component.
    return F.transform(F.array(F.when(length == 0, F.lit(1.0)).otherwise(length)), lambda n: F.transform(v, lambda x: x / n))[0]


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(unit(a), unit(b))
