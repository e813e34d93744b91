"""Reports composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.operators import metrics, regret


def ab_report(log: DataFrame, history: DataFrame, arms: tuple[str, ...] = ("control", "treatment")) -> DataFrame:
    """CTR, conversion, return rate and category novelty per experiment arm, plus the shadow sample size."""
    known = history.select("user_id", "category").distinct().withColumn("_known", F.lit(True))
    joined = log.join(known, ["user_id", "category"], "left").withColumn(
        "arm", metrics.experiment_arm(F.col("user_id"), list(arms)))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return joined.groupBy("arm").agg(
        n("view").alias("impressions"),
        (n("click") / at_least_one(n("view"))).alias("ctr"),
        (n("purchase") / at_least_one(n("click"))).alias("conversion"),
        (n("return") / at_least_one(n("purchase"))).alias("return_rate"),
        F.avg(F.col("_known").isNull().cast("double")).alias("discovery"),
        F.count_if(metrics.in_shadow(F.col("user_id"), S.SHADOW_RATIO)).alias("shadow_rows"))


def evaluation_report(predicted: DataFrame, actual: DataFrame, relevance: DataFrame, recs: DataFrame,
                      history: DataFrame, log: DataFrame, purchases: DataFrame, rings: tuple[DataFrame, DataFrame],
                      k: int = 50) -> DataFrame:
    """One row per metric with its target: (metric, value, target)."""
    # Published targets.
    targets = {"ndcg": 0.88, "ctr_lift": 0.30, "return_rate": 0.02, "discovery": 0.15, "ring_recall": 0.95}
    pr = metrics.precision_recall(predicted, actual, k).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    rows = [
        metrics.ndcg(relevance, k).agg(F.avg("ndcg").alias("value")).withColumn("metric", F.lit("ndcg")),
        pr.select(F.col("precision").alias("value"), F.lit("precision").alias("metric")),
        pr.select(F.col("recall").alias("value"), F.lit("recall").alias("metric")),
        metrics.discovery_score(recs, history).agg(F.avg("discovery_score").alias("value")).withColumn("metric", F.lit("discovery")),
        regret.overall_return_rate(purchases).select(F.col("return_rate").alias("value"), F.lit("return_rate").alias("metric")),
        metrics.fraud_ring_recall(*rings).select(F.col("recall").alias("value"), F.lit("ring_recall").alias("metric")),
    ]
    kind, arm = F.col("event_type"), metrics.experiment_arm(F.col("user_id"), ["control", "treatment"])
    rates = metrics.ctr(log.withColumn("arm", arm), ["arm"], kind == "view", kind == "click")
    one = lambda a: F.coalesce(F.max(F.when(F.col("arm") == a, F.col("ctr"))), F.lit(0.0))
    rows.append(rates.agg(metrics.lift(one("treatment"), one("control")).alias("value")).withColumn("metric", F.lit("ctr_lift")))
    out = rows[0].select("metric", "value")
    for row in rows[1:]:
        out = out.unionByName(row.select("metric", "value"))
    goal = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return out.withColumn("target", F.try_element_at(goal, F.col("metric")))


def return_aware_report(candidates: DataFrame, purchases: DataFrame, profile: DataFrame) -> DataFrame:
    """Per category: purchases, returns, rate, mean penalty and how many places its items move on re-ranking.

    ``candidates(user_id, item_id, category, price, base_score)``.
    """
    from keeprank.operators.ranking import ranked

    before = ranked(candidates, ["user_id"], [F.desc("base_score"), F.asc("item_id")], "old_rank")
    after = regret.rerank_regret(before, profile)
    moves = after.groupBy("category").agg(
        F.count("*").alias("candidates"), F.avg("penalty").alias("avg_penalty"),
        F.sum(F.abs(F.col("rank") - F.col("old_rank"))).alias("places_moved"))
    rates = purchases.groupBy("category").agg(
        F.count("*").alias("purchases"), F.count_if(F.col("return_ts").isNotNull()).alias("returns"))
    return rates.join(moves, "category", "left").withColumn("return_rate", F.col("returns") / F.col("purchases"))
