"""Scalar scoring rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.functions.arrays import slice_sum


def freshness_weight(ts: Column, now: Column, half_life_days: float = S.HALF_LIFE_DAYS) -> Column:
    age_days = (F.unix_seconds(now) - F.unix_seconds(ts)) / F.lit(86400.0)
    return F.pow(F.lit(2.0), -age_days / F.lit(float(half_life_days)))


def price_bucket(price: Column) -> Column:
    return (
        F.when(price < 10, "0-10").when(price < 50, "10-50").when(price < 100, "50-100")
        .when(price < 500, "100-500").otherwise("500+")
    )


def segment_key(category: Column, price: Column) -> Column:
    return F.concat_ws(":", category, price_bucket(price))


def sensitivity_class(elasticity: Column, low: float = -0.5, high: float = -2.0) -> Column:
    return F.when(elasticity >= low, "low").when(elasticity >= high, "medium").otherwise("high")


def elasticity_score(
    base: Column, price: Column, rating: Column, weight: Column, sensitivity: Column, legacy: bool = False
) -> Column:
    """Blend of value and quality; a highly sensitive user is judged on quality per unit of price.

    ``legacy`` applies the low/medium form to everyone.
    """
    sensitive = F.lit(False) if legacy else sensitivity == "high"
    value = F.when(sensitive, rating / F.greatest(price, F.lit(0.01))).otherwise(rating)
    quality = F.when(sensitive, rating).otherwise(rating * (F.lit(1.0) + F.lit(0.1) * (F.lit(5.0) - price)))
    mixed = (F.lit(1.0) - weight) * value + weight * quality
    return base * (F.lit(0.5) + F.lit(0.5) * mixed / F.greatest(rating, F.lit(1.0)))


def composite_score(
    relevance: Column, recency: Column, inventory: Column, margin: Column,
    weights: tuple[float, float, float, float] = (0.55, 0.20, 0.10, 0.15),
) -> Column:
    parts = [F.lit(w) * c for w, c in zip(weights, (relevance, recency, inventory, margin))]
    return parts[0] + parts[1] + parts[2] + parts[3]


def regret_penalty(
    num_purchases: Column, return_rate: Column,
    threshold: float = S.RETURN_RATE_THRESHOLD, strength: float = S.REGRET_LAMBDA,
    min_purchases: int = S.REGRET_MIN_PURCHASES, floor: float = S.REGRET_FLOOR,
) -> Column:
    """Multiplier in [floor, 1]; 1 without a profile, with too little data, or below the threshold."""
    penalised = (num_purchases >= min_purchases) & (return_rate > threshold)
    return F.when(
        penalised, F.greatest(F.lit(floor), F.lit(1.0) - (return_rate - F.lit(threshold)) * F.lit(strength))
    ).otherwise(F.lit(1.0))


def hour_bucket(ts: Column, buckets: int = S.RING_BUCKETS) -> Column:
    return F.pmod(F.floor(F.unix_seconds(ts) / 3600), F.lit(buckets))


def popularity(rating: Column, review_count: Column, inventory: Column) -> Column:
    stock = F.least(F.lit(1.0), inventory / F.lit(100.0))
    return (F.lit(0.4) * rating + F.lit(0.3) * F.log1p(review_count)) * (F.lit(0.5) + F.lit(0.5) * stock)


def price_score(sensitivity: Column, price: Column, rating: Column) -> Column:
    return (
        F.when(sensitivity == "high", F.greatest(F.lit(0.0), F.lit(1.0) - price / F.lit(200.0)))
        .when(sensitivity == "low", F.lit(0.5) + F.lit(0.5) * (rating / F.lit(5.0)))
        .otherwise(F.lit(0.5))
    )


def stockout_probability(forecast: Column, inventory: Column, days: int = S.SAFETY_DAYS) -> Column:
    demand = slice_sum(forecast, days)
    return F.when(demand <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), demand / F.greatest(inventory.cast("double"), F.lit(1.0)))
    )


def stock_status(probability: Column) -> Column:
    return F.when(probability > 0.7, "LOW").when(probability < 0.3, "OK").otherwise("Medium")


def fraud_demotion(score: Column, probability: Column,
                   threshold: float = S.FRAUD_SUSPECT, factor: float = S.FRAUD_DEMOTION) -> Column:
    return F.when(probability >= threshold, score * F.lit(factor)).otherwise(score)


def bandit_context(metadata: Column, features: list[str] = S.BANDIT_FEATURES) -> Column:
    """Map of feature values -> fixed-order vector; a missing feature counts as 0."""
    return F.array(*[F.coalesce(F.try_element_at(metadata, F.lit(f)), F.lit(0.0)) for f in features])


def expires_at(ts: Column, ttl_seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(ttl_seconds))


def is_live(created: Column, now: Column, ttl_seconds: int) -> Column:
    return now <= expires_at(created, ttl_seconds)
