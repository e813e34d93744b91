"""Return-aware profiles, penalties and return matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.functions import scoring
from keeprank.operators.ranking import rerank, top_k


def return_outcome(purchases: DataFrame) -> DataFrame:
    seconds = F.unix_seconds("return_ts") - F.unix_seconds("purchase_ts")
    return purchases.withColumn("returned", F.col("return_ts").isNotNull()).withColumn(
        "days_to_return", seconds / F.lit(86400.0))


def _segment(grain: str | Column) -> Column:
    if isinstance(grain, Column):
        return grain
    if grain == "segment":
        return scoring.segment_key(F.col("category"), F.col("price"))
    if grain == "category":
        return F.col("category")
    raise ValueError(f"unknown grain {grain!r}")


def regret_profile(purchases: DataFrame, grain: str | Column = "segment", now: Column | None = None,
                   window_days: int | None = None) -> DataFrame:
    """Purchases, returns, return rate and mean regret rating per segment (per category, or per a given column)."""
    if window_days is not None:
        oldest = now - F.make_dt_interval(days=F.lit(window_days))
        purchases = purchases.filter((F.col("purchase_ts") >= oldest) & (F.col("purchase_ts") <= now))
    returned = F.count_if(F.col("return_ts").isNotNull())
    return purchases.groupBy(_segment(grain).alias("segment")).agg(
        F.count("*").alias("num_purchases"),
        returned.alias("num_returns"),
        (returned / F.count("*")).alias("return_rate"),
        F.coalesce(F.avg("regret_rating"), F.lit(0.0)).alias("avg_regret"),
    )


def with_penalty(items: DataFrame, profile: DataFrame, grain: str = "segment", **params) -> DataFrame:
    """Attach the penalty of the item's own segment; items without a profile keep 1."""
    small = profile.select("segment", "num_purchases", "return_rate")
    return (
        items.withColumn("segment", _segment(grain))
        .join(small, "segment", "left")
        .withColumn("penalty", scoring.regret_penalty(F.col("num_purchases"), F.col("return_rate"), **params))
        .drop("num_purchases", "return_rate")
    )


def regret_classes(purchases: DataFrame, threshold: float = S.RETURN_RATE_THRESHOLD) -> DataFrame:
    profile = regret_profile(purchases, "category")
    rate = F.col("return_rate")
    return profile.select(
        F.col("segment").alias("category"), "return_rate",
        F.when(rate > threshold * 1.5, "high").when(rate < threshold * 0.5, "low").otherwise("neutral").alias("regret"),
    )


def regret_summary(profile: DataFrame, threshold: float = S.RETURN_RATE_THRESHOLD) -> DataFrame:
    return profile.withColumn("needs_attention", F.col("return_rate") > threshold)


def regret_rollup(purchases: DataFrame) -> DataFrame:
    """Return rate over (user_segment, category, price range) with subtotals."""
    ranged = purchases.withColumn("price_range", scoring.price_bucket(F.col("price")))
    return ranged.rollup("user_segment", "category", "price_range").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("num_purchases"),
        F.count_if(F.col("return_ts").isNotNull()).alias("num_returns"),
    ).withColumn("return_rate", F.col("num_returns") / F.col("num_purchases"))


def overall_return_rate(purchases: DataFrame) -> DataFrame:
    return purchases.agg(
        F.count("*").alias("num_purchases"), F.count_if(F.col("return_ts").isNotNull()).alias("num_returns")
    ).withColumn("return_rate", F.coalesce(
        F.try_divide(F.col("num_returns"), F.col("num_purchases")), F.lit(0.0)))


def rerank_regret(candidates: DataFrame, profile: DataFrame, grain: str = "segment", k: int | None = None) -> DataFrame:
    """``candidates(user_id, item_id, category, price, base_score)``."""
    scored = with_penalty(candidates, profile, grain)
    return rerank(scored, "user_id", F.col("base_score") * F.col("penalty"), k=k)


def match_returns(purchases: DataFrame, returns: DataFrame) -> DataFrame:
    """Exact match on (user, item, purchase time); the last-recorded purchase takes the return.

    Several returns on one key keep the latest; returns without a purchase match nothing.
    """
    key = ["user_id", "item_id", "purchase_ts"]
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    last = returns.groupBy(*key).agg(F.max(F.struct("return_ts", "regret_rating")).alias("r"))
    return (
        purchases.withColumn("_rn", F.row_number().over(w))
        .join(last.withColumn("_rn", F.lit(1)), key + ["_rn"], "left")
        .select(*purchases.columns, F.col("r.return_ts").alias("return_ts"), F.col("r.regret_rating").alias("regret_rating"))
    )


def match_returns_asof(purchases: DataFrame, returns: DataFrame, within_days: int = S.RETURN_WINDOW_DAYS) -> DataFrame:
    """Latest purchase of the same user and item at or before the return, at most ``within_days`` old.

    One ordered pass over both logs per (user, item); no pair is ever materialised.
    """
    log = purchases.select("user_id", "item_id", F.col("purchase_ts").alias("ts"), F.lit(0).alias("kind"),
                           F.col("purchase_ts").alias("purchase_ts"))
    back = returns.select("user_id", "item_id", F.col("return_ts").alias("ts"), F.lit(1).alias("kind"),
                          F.lit(None).cast("timestamp").alias("purchase_ts"))
    w = Window.partitionBy("user_id", "item_id").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.unionByName(back).withColumn("last_purchase", F.last("purchase_ts", ignorenulls=True).over(w))
    recent = F.unix_seconds("ts") - F.unix_seconds("last_purchase") <= within_days * 86400
    return seen.filter("kind = 1").select(
        "user_id", "item_id", F.col("ts").alias("return_ts"),
        F.when(recent, F.col("last_purchase")).alias("purchase_ts"))


def worst_segments(profile: DataFrame, k: int) -> DataFrame:
    return top_k(profile.withColumn("_all", F.lit(1)), ["_all"], [F.desc("return_rate"), F.asc("segment")], k).drop("_all")
