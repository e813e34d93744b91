"""Offline evaluation and monitoring metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank.functions.hashing import md5_60
from keeprank.operators.ranking import top_k

SKETCH_ACCURACY = 10_000
BINS = 4_096


def ctr(events: DataFrame, keys: list[str], impression: Column, click: Column) -> DataFrame:
    shown, clicked = F.count_if(impression), F.count_if(click)
    return events.groupBy(*keys).agg(shown.alias("impressions"), clicked.alias("clicks")).withColumn(
        "ctr", F.col("clicks") / F.greatest("impressions", F.lit(1)))


def lift(treatment: Column, control: Column) -> Column:
    return F.when(control == 0, F.lit(0.0)).otherwise((treatment - control) / control)


def return_rate(purchases: DataFrame, keys: list[str]) -> DataFrame:
    return purchases.groupBy(*keys).agg(F.count("*").alias("purchased"), F.count_if("is_returned").alias("returned")).withColumn(
        "return_rate", F.col("returned") / F.greatest("purchased", F.lit(1)))


def discovery_score(recs: DataFrame, history: DataFrame) -> DataFrame:
    """Share of recommended rows whose category is new to the user. ``recs(user_id, category)``."""
    known = history.select("user_id", "category").distinct().withColumn("_known", F.lit(True))
    return recs.join(known, ["user_id", "category"], "left").groupBy("user_id").agg(
        F.avg(F.col("_known").isNull().cast("double")).alias("discovery_score"))


def discovery_windows(recs: DataFrame, sizes: tuple[int, ...] = (7, 14, 20)) -> DataFrame:
    """Share of flagged rows within the first n positions, one column per n."""
    shares = [F.avg(F.when(F.col("rank") <= n, F.col("is_discovery").cast("double"))).alias(f"share_{n}") for n in sizes]
    return recs.groupBy("user_id").agg(*shares)


def precision_recall(predicted: DataFrame, actual: DataFrame, k: int = 50) -> DataFrame:
    """Per user; ``predicted(user_id, item_id, rank)``, ``actual(user_id, item_id)``. Empty lists give 0."""
    cut = predicted.filter(F.col("rank") <= k)
    length = cut.groupBy("user_id").agg(F.count("*").alias("listed"))
    truth = actual.select("user_id", "item_id").distinct()
    size = truth.groupBy("user_id").agg(F.count("*").alias("relevant"))
    hits = cut.select("user_id", "item_id").distinct().join(truth, ["user_id", "item_id"]).groupBy("user_id").agg(
        F.count("*").alias("hits"))
    joined = length.join(size, "user_id", "full").join(hits, "user_id", "left").fillna(0, ["listed", "relevant", "hits"])
    return joined.select(
        "user_id", "hits", F.coalesce(F.try_divide("hits", "listed"), F.lit(0.0)).alias("precision"),
        (F.col("hits") / F.greatest("relevant", F.lit(1))).alias("recall"))


def ndcg(ranked: DataFrame, k: int = 50) -> DataFrame:
    """Per user; ``ranked(user_id, item_id, rank, relevance)``. Zero where nothing is relevant."""
    best = Window.partitionBy("user_id").orderBy(F.desc("relevance"), F.asc("rank"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    placed = ranked.withColumn("_ideal", F.row_number().over(best))

    def discounted(position: str) -> Column:
        return F.sum(F.when(F.col(position) <= k, gain / F.log2(F.col(position) + F.lit(1.0))).otherwise(0.0))

    return placed.groupBy("user_id").agg(discounted("rank").alias("_dcg"), discounted("_ideal").alias("_idcg")).select(
        "user_id", F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"))


def fraud_ring_recall(detected: DataFrame, actual: DataFrame) -> DataFrame:
    """Share of actual ring members that were flagged; both have array column ``members``. 1 when there are none."""
    flagged = detected.select(F.explode("members").alias("m")).distinct().withColumn("_hit", F.lit(1))
    real = actual.select(F.explode("members").alias("m")).distinct()
    return real.join(flagged, "m", "left").agg(
        F.count("*").alias("actual"), F.count("_hit").alias("found")).withColumn(
        "recall", F.coalesce(F.try_divide("found", "actual"), F.lit(1.0)))


def latency_stats(timings: DataFrame, key: str = "step", value: str = "ms", approximate: bool = False) -> DataFrame:
    """Mean and p99 per step. Exact p99 is the 0-based element floor(0.99·n) of the sorted values; null values take no part.

    A mergeable quantile sketch with a fixed rank error brackets the element, counts of ``BINS`` equal parts of the bracket name the part that
    holds it, and only the distinct values of that part are ordered.
    """
    known = timings.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    if approximate:
        return known.groupBy(key).agg(F.avg("_v").alias("mean"), F.percentile_approx("_v", 0.99, SKETCH_ACCURACY).alias("p99"))
    slack = 4 / SKETCH_ACCURACY
    bounds = F.percentile_approx("_v", [0.99 - slack, min(0.99 + slack, 1.0)], SKETCH_ACCURACY)
    totals = known.groupBy(key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), bounds.alias("_b")).select(
        key, "n", "mean", F.floor(F.col("n") * 99 / 100).alias("_at"), F.get("_b", F.lit(0)).alias("_lo"), F.get("_b", F.lit(1)).alias("_hi"))
    share = F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    # -1: below the bracket, BINS: above it; both are one row a step
    part = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    binned = known.join(totals, key).withColumn("_part", part.cast("int"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy("_part"))
    parts = binned.groupBy(key, "_part").agg(F.count("*").alias("_c")).withColumn("_before", upto - F.col("_c"))
    chosen = parts.join(totals.select(key, "_at"), key).filter(
        (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c"))).select(key, "_part", "_before")
    inside = binned.join(chosen, [key, "_part"]).groupBy(key, "_v").agg(
        F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_at").alias("_at"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    reached = F.sum("_c").over(Window.partitionBy(key).orderBy("_v")) + F.col("_before")
    return inside.withColumn("_upto", reached).filter(F.col("_upto") > F.col("_at")).groupBy(key).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("_v").alias("p99"))


def rank_overlap(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Shared and exclusive items of two result lists and their Jaccard similarity."""
    left, right = a.select(item).distinct().withColumn("_a", F.lit(1)), b.select(item).distinct().withColumn("_b", F.lit(1))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return left.join(right, item, "full").agg(
        both.alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.coalesce(F.try_divide(both, F.count("*")), F.lit(0.0)).alias("jaccard"))


def experiment_arm(user_id: Column, arms: list[str], seed: int = 7) -> Column:
    index = md5_60(user_id, seed) % len(arms)
    return F.get(F.array(*[F.lit(a) for a in arms]), index.cast("int"))


def in_shadow(user_id: Column, ratio: float, seed: int = 11) -> Column:
    return md5_60(user_id, seed) % 10_000 < int(ratio * 10_000)


def popularity_rank(scored: DataFrame, k: int, score: str = "popularity") -> DataFrame:
    from keeprank.operators.ranking import global_top_k

    return global_top_k(scored, [F.desc(score), F.asc("item_id")], k)


def arm_stats(pulls: DataFrame, warm: int) -> DataFrame:
    """Pulls, total and average reward, and the warm flag per arm."""
    return pulls.groupBy("arm_id").agg(F.count("*").alias("pulls"), F.sum("reward").alias("total_reward")).withColumn(
        "avg_reward", F.col("total_reward") / F.greatest("pulls", F.lit(1))).withColumn("is_warm", F.col("pulls") >= warm)


def top_items(df: DataFrame, k: int) -> DataFrame:
    return top_k(df, ["user_id"], [F.desc("score"), F.asc("item_id")], k)
