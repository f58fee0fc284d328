"""Column expressions over vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def has_infinite(a: Column) -> Column:
    return F.exists(a, lambda x: F.abs(x) == float("inf"))


def max_similarity(query: Column, page: Column) -> Column:
    """Late interaction: the sum over query vectors of the best inner product with a page vector."""
    best = F.transform(query, lambda q: F.array_max(F.transform(page, lambda p: dot(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda total, x: total + x)
