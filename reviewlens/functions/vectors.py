"""Vector arithmetic on ``array<float>`` and ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Sum of element-wise products in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    squared = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squared)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when either has no length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))
