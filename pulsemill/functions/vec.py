"""Vector functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Null for zero vectors. Norms can be given where they are computed once for each row."""
    n = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(n > 0, dot(a, b) / n)


def similarity(distance: Column, metric: str) -> Column:
    return 1 - distance if metric == "cosine" else distance if metric == "ip" else 1 / (1 + distance)


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "ip":
        return dot(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
