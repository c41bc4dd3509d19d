"""Vector functions as Column expressions over arrays. Sums run in double precision unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector at length 1, in float; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: (x.cast("double") / size).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """For unit vectors."""
    return 1.0 - dot(a, b)
