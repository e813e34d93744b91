"""Training-set generation: positives, sampled negatives, union, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.operators import sampling


def training_set(interactions: DataFrame, items: DataFrame, negatives_per_user: int = 100, test_fraction: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """(user_id, item_id, rating, ts, category, is_test); the highest rating of a pair is its positive."""
    positives = interactions.filter("rating > 0").groupBy("user_id", "item_id").agg(
        F.max("rating").alias("rating"), F.max("ts").alias("ts"))
    negatives = sampling.negative_samples(positives, items, negatives_per_user, seed)
    rows = sampling.training_union(positives, negatives, items)
    return sampling.train_test_split(rows, ["user_id", "item_id"], test_fraction, seed)
