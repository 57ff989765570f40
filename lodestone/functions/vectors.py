"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, different lengths and zero vectors; accumulated in doubles."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(a.cast("array<double>"))
