"""Taste divergence, life events and their effect on user vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.functions.arrays import blend
from keeprank.session import small_table

# Life events in tie order with their categories.
LIFE_EVENTS = {
    "baby": ["baby", "diapers", "baby_food", "toys"],
    "new_home": ["furniture", "home_decor", "appliances", "tools"],
    "marriage": ["wedding", "rings", "formal_wear", "honeymoon"],
    "career_change": ["professional_courses", "office_wear", "tech"],
    "retirement": ["travel", "hobbies", "health", "leisure"],
    "fitness": ["sports", "nutrition", "workout_gear"],
}


def cluster_table(spark: SparkSession, clusters: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(event, pos, cat) for pos, (event, cats) in enumerate((clusters or LIFE_EVENTS).items()) for cat in cats]
    return small_table(spark, rows, "event_type STRING, event_order INT, category STRING")


def jaccard(a, b):
    """Set overlap of two arrays; 0 if either is empty."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.greatest(total, F.lit(1)))


def rolling_divergence(divergences: DataFrame, window: int = S.DIVERGENCE_WINDOW,
                       threshold: float = S.DIVERGENCE_THRESHOLD) -> DataFrame:
    """Mean of the last ``window`` divergences per (user, cohort) pair and the alarm flag."""
    w = Window.partitionBy("user_id", "ref_id").orderBy("seq").rowsBetween(-(window - 1), 0)
    return divergences.withColumn("mean_divergence", F.avg("divergence").over(w)).withColumn(
        "observations", F.count("*").over(w)).withColumn("alarm", F.col("mean_divergence") > threshold)


def divergence_steps(baseline: DataFrame, pairs: DataFrame, batches: DataFrame) -> DataFrame:
    """Old minus new similarity per pair and batch of new activity.

    ``baseline(user_id, cats)``, ``pairs(user_id, ref_id)``, ``batches(user_id, seq, new_cats)``.
    """
    own = baseline.select("user_id", F.col("cats").alias("own"))
    ref = baseline.select(F.col("user_id").alias("ref_id"), F.col("cats").alias("ref"))
    joined = pairs.join(own, "user_id").join(ref, "ref_id").join(batches, "user_id")
    before = jaccard(F.col("own"), F.col("ref"))
    after = jaccard(F.array_union("own", "new_cats"), F.col("ref"))
    return joined.select("user_id", "ref_id", "seq", (before - after).alias("divergence"))


def best_event(activity: DataFrame, clusters: DataFrame) -> DataFrame:
    """``activity(user_id, seq, category, n)`` -> the cluster with the largest share of the activity."""
    keys = ["user_id", "seq"]
    total = activity.groupBy(*keys).agg(F.sum("n").alias("total"))
    hits = activity.join(clusters, "category").groupBy(*keys, "event_type", "event_order").agg(
        F.sum("n").alias("hit"), F.array_sort(F.collect_set("category")).alias("catalyst_categories"))
    scored = hits.join(total, keys).withColumn("share", F.col("hit") / F.greatest("total", F.lit(1)))
    best = scored.groupBy(*keys).agg(F.max_by(
        F.struct("event_type", "share", "catalyst_categories"), F.struct(F.col("share"), -F.col("event_order"))).alias("e"))
    return best.select(*keys, "e.*").withColumn("confidence", F.least(F.lit(1.0), F.col("share") * 1.5))


def life_events(steps: DataFrame, activity: DataFrame, clusters: DataFrame, min_observations: int = 1,
                min_confidence: float = S.EVENT_CONFIDENCE, **params) -> DataFrame:
    """Alarmed pair steps whose best cluster is confident enough."""
    rolled = rolling_divergence(steps, **params)
    alarmed = rolled.filter(F.col("alarm") & (F.col("observations") >= min_observations))
    return alarmed.join(best_event(activity, clusters), ["user_id", "seq"]).filter(
        F.col("confidence") > min_confidence)


def fork_versions(events: DataFrame) -> DataFrame:
    """Embedding version after each fork: 1 before the first, +1 per detected event."""
    w = Window.partitionBy("user_id").orderBy("detected_at", "event_type")
    return events.withColumn("version", F.row_number().over(w).cast("bigint") + 1)


def fork_embedding(users: DataFrame, events: DataFrame, bias: DataFrame) -> DataFrame:
    """Blend the vector with the event's bias vector, weight = min(1, confidence / 2)."""
    weight = F.least(F.lit(1.0), F.col("confidence") * 0.5)
    return events.join(users, "user_id").join(bias, "event_type").withColumn(
        "forked", blend(F.col("vector"), F.col("bias"), weight))


def propagate_fork(forked: DataFrame, neighbors: DataFrame, users: DataFrame, strength: float = 0.3,
                   hop: int = 1) -> DataFrame:
    """Pull each neighbour towards the forked vector by similarity·strength/hop.

    A neighbour of several forked users moves towards their mean with the mean blend weight.
    ``forked(user_id, forked)``, ``neighbors(user_id, neighbor_id, similarity)``.
    """
    from keeprank.operators.features import mean_vectors

    pulled = neighbors.join(forked, "user_id").join(
        users.select(F.col("user_id").alias("neighbor_id"), F.col("vector")), "neighbor_id")
    moved = pulled.select("neighbor_id", blend(
        F.col("vector"), F.col("forked"), F.col("similarity") * F.lit(strength / hop)).alias("moved"))
    return mean_vectors(moved, "neighbor_id", "moved").withColumnRenamed("mean_vector", "vector")
