"""Seller indicators, seller–seller links and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.operators.graph import connected_components
from keeprank.operators.similarity import link_stars, link_sums, similar_sets, vector_join
from keeprank.session import write_and_read


def seller_indicators(reviews: DataFrame) -> DataFrame:
    """Timing entropy, prefix diversity, rating skew and account burstiness per seller.

    Everything is counted per (seller, slot) or (seller, user) first, so one busy seller is many small groups.
    """
    slots = reviews.groupBy("seller_id", F.weekday("ts").alias("slot")).agg(F.count("*").alias("n"))
    totals = reviews.groupBy("seller_id").agg(
        F.count("*").alias("reviews"), F.count_distinct("ip_group").alias("prefixes"),
        F.skewness("rating").alias("rating_skew"), F.avg("rating").alias("avg_rating"))
    share = F.col("n") / F.col("reviews")
    entropy = slots.join(totals.select("seller_id", "reviews"), "seller_id").groupBy("seller_id").agg(
        F.sum(-share * F.log(share)).alias("timing_entropy"))
    accounts = reviews.groupBy("seller_id", "user_id").agg(F.count("*").alias("c")).groupBy("seller_id").agg(
        (F.max("c") / F.sum("c")).alias("burstiness"))
    return totals.join(entropy, "seller_id").join(accounts, "seller_id").withColumn(
        "ip_diversity", F.col("prefixes") / F.col("reviews"))


def ip_overlap_pairs(reviews: DataFrame, threshold: float = S.IP_OVERLAP) -> DataFrame:
    """Groups of sellers with (nearly) the same prefix sets; sellers with equal sets form one row."""
    sets = reviews.groupBy("seller_id").agg(
        F.array_sort(F.collect_set(F.col("ip_group").cast("string"))).alias("prefixes"))
    return similar_sets(sets, "prefixes", threshold).withColumnRenamed("similarity", "overlap")


def timing_vectors(reviews: DataFrame, slot: Column, slots: int) -> DataFrame:
    """Centred review counts per time slot; the cosine of two such vectors is their correlation."""
    counts = [F.count_if(slot == i).cast("double") for i in range(slots)]
    raw = reviews.filter("seller_id IS NOT NULL").groupBy("seller_id").agg(F.array(*counts).alias("counts"))
    mean = F.aggregate("counts", F.lit(0.0), lambda a, v: a + v) / F.lit(float(slots))
    return raw.select("seller_id", F.transform("counts", lambda v: v - mean).alias("timing"))


def _flat(vectors: DataFrame) -> DataFrame:
    """``flat``: the same count in every slot, so a correlation with this seller is not a number."""
    return vectors.withColumn("flat", F.forall("timing", lambda v: v == 0))


def timing_pairs(reviews: DataFrame, slot: Column, slots: int, threshold: float = S.TIMING_CORRELATION) -> DataFrame:
    """Pairs whose correlation reaches ``threshold``. NaN counts as larger than every number, so a flat seller pairs with all."""
    vectors = write_and_read(_flat(timing_vectors(reviews, slot, slots)), "timing")
    varied = vectors.filter("NOT flat")
    found = vector_join(varied, varied, "seller_id", "seller_id", "timing", "timing", min_similarity=threshold,
                        same_table=True, digits=None)
    flat = vectors.filter("flat").select(F.col("seller_id").alias("_flat_id"))
    other = (F.col("seller_id") > F.col("_flat_id")) | (~F.col("flat") & (F.col("seller_id") < F.col("_flat_id")))
    undefined = vectors.select("seller_id", "flat").join(flat, other).select(
        F.least("seller_id", "_flat_id").alias("seller_a"), F.greatest("seller_id", "_flat_id").alias("seller_b"),
        F.lit(float("nan")).alias("correlation"))
    return found.select(F.col("seller_id").alias("seller_a"), F.col("seller_id_b").alias("seller_b"),
                        F.col("similarity").alias("correlation")).unionByName(undefined)


def timing_stars(reviews: DataFrame, slot: Column, slots: int, threshold: float = S.TIMING_CORRELATION) -> DataFrame:
    """(seller_a, seller_b): few edges that connect the same sellers as all of ``timing_pairs``."""
    vectors = write_and_read(_flat(timing_vectors(reviews, slot, slots)), "timing")
    hub = vectors.filter("flat").agg(F.min("seller_id").alias("seller_a")).filter("seller_a IS NOT NULL")
    spokes = vectors.select(F.col("seller_id").alias("seller_b")).join(hub, F.col("seller_a") != F.col("seller_b"))
    return link_stars(vectors.filter("NOT flat"), "seller_id", "timing", threshold).toDF("seller_a", "seller_b").unionByName(
        spokes.select("seller_a", "seller_b"))


def candidate_map(items: DataFrame, indicators: DataFrame) -> DataFrame:
    """item -> seller -> probability; sellers without an indicator count as 0."""
    risk = indicators.select("seller_id", "probability")
    return items.select("item_id", "seller_id").join(risk, "seller_id", "left").withColumn(
        "probability", F.coalesce("probability", F.lit(0.0)))


def suspicion(indicators: DataFrame) -> DataFrame:
    """Weighted rule score in [0, 1]: low timing entropy, few prefixes, extreme ratings, bursty accounts."""
    flat = F.lit(1.0) - F.least(F.lit(1.0), F.col("timing_entropy") / F.log(F.lit(7.0)))
    narrow = F.lit(1.0) - F.least(F.lit(1.0), F.col("prefixes") / F.lit(25.0))
    high = F.greatest(F.lit(0.0), (F.col("avg_rating") - 4) / F.lit(1.0))
    return indicators.withColumn("probability", F.least(F.lit(1.0), (
        0.3 * flat + 0.3 * narrow + 0.2 * high + 0.2 * F.col("burstiness"))))


def smooth_scores(features: DataFrame, timing: DataFrame, width: int, threshold: float = S.TIMING_CORRELATION, rounds: int = 3) -> DataFrame:
    """Neighbour averaging with a residual: v <- (v + mean of neighbours) / 2, for ``features(seller_id, vector)``.

    Neighbours are the pairs of ``timing(seller_id, timing)`` that reach ``threshold``; their vectors are summed where
    the pairs are found, so no pair is written.
    """
    state = features.select("seller_id", "vector").join(timing, "seller_id", "left")
    for _ in range(rounds):
        state = write_and_read(state, "seller-scores")
        heard = link_sums(state.filter("vector IS NOT NULL"), "seller_id", "timing", "vector", width, threshold)
        mean = F.transform("sums", lambda v: v / F.col("n"))
        state = state.join(heard, "seller_id", "left").select(
            "seller_id", F.coalesce(F.zip_with("vector", mean, lambda a, b: (a + b) / 2), F.col("vector")).alias("vector"), "timing")
    return state.select("seller_id", "vector")


def fraud_rings(pairs: DataFrame) -> DataFrame:
    """Ring id (smallest seller) and size per linked seller."""
    members = connected_components(pairs.select(F.col("seller_a").alias("a"), F.col("seller_b").alias("b")))
    sizes = members.groupBy("component").agg(F.count("*").alias("ring_size"))
    return members.join(sizes, "component").select(
        F.col("node").alias("seller_id"), F.col("component").alias("ring_id"), "ring_size")


def suspicious_reviews(reviews: DataFrame, days: int = 7) -> DataFrame:
    """Rule score per (seller, time window): tight timing, high ratings, few prefixes.

    The spread is taken of the microseconds since the window began and rounded to microseconds, so a deviation of exactly
    one day is never tight, in whatever order the reviews come.
    """
    window = F.floor(F.unix_date(F.to_date("ts")) / days)
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - window * F.lit(days * 86_400_000_000)) / F.lit(1e6)
    grouped = reviews.groupBy("seller_id", window.alias("window")).agg(
        F.count("*").alias("reviews"), F.round(F.stddev_pop(since), 6).alias("spread"),
        F.avg("rating").alias("avg_rating"), F.count_distinct("ip_group").alias("prefixes"))
    tight = (F.col("spread") < 86400).cast("int")
    high = (F.round("avg_rating", 9) >= 4).cast("int")
    narrow = (F.col("prefixes") / F.col("reviews") <= 0.5).cast("int")
    return grouped.withColumn("score", ((tight + high + narrow) / 3) * (F.col("reviews") >= 2).cast("int"))
