"""Vector arithmetic on array columns, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    """The array with every component cast to double."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, left to right; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column, by: Column) -> Column:
    """Each component times ``by``."""
    return F.transform(a, lambda x: x * by)


def unit(a: Column, eps: float = 0.0) -> Column:
    """a / (|a| + eps); a zero vector with eps 0 gives nulls."""
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: F.try_divide(x, n))
