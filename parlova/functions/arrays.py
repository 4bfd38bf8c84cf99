"""Arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest for stability."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(
        shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y)
    )
