"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    """x within 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity(distance: Column, space: str = "cosine") -> Column:
    """Similarity in 0..1 from an index distance; squared l2 of unit vectors is halved."""
    return clamp(1 - distance / 2) if space == "l2" else clamp(1 - distance)


def recency(ts: Column, now: Column, half_life_days: float = 90.0) -> Column:
    """Halves every half life; a time to come counts as now."""
    days = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400e6), F.lit(0.0))
    return clamp(F.pow(F.lit(2.0), -days / half_life_days))


def memory_score(semantic: Column, recent: Column, weight: float = 0.8) -> Column:
    return F.round(weight * clamp(semantic) + (1 - weight) * clamp(recent), 4)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
