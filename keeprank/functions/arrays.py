"""Vector arithmetic on ARRAY<DOUBLE> columns with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero when either vector has zero length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_normalise(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def temperature_score(a: Column, b: Column, tau: float) -> Column:
    return cosine(a, b) / F.lit(tau)


def mood_score(user: Column, item: Column, bias: Column) -> Column:
    return dot(user, item) + dot(bias, item)


def blend(a: Column, b: Column, weight: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (F.lit(1.0) - weight) * x + weight * y)


def slice_sum(values: Column, days: Column | int) -> Column:
    return F.aggregate(F.slice(values, F.lit(1), F.lit(days) if isinstance(days, int) else days),
                       F.lit(0.0), lambda acc, v: acc + v)
