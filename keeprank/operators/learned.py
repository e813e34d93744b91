"""Learned scores with pyspark.ml, attributions and context-conditioned vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keeprank.functions.scoring import freshness_weight
from keeprank.operators.features import mean_vectors
from keeprank.operators.ranking import top_k
from keeprank.session import write_and_read


def linear_attributions(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Exact contributions of a linear score: coefficient · (value − column mean), as name and value arrays."""
    means = rows.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    parts = [F.lit(float(w)) * (F.col(c) - F.lit(float(means[c] or 0.0))) for c, w in coefficients.items()]
    return rows.withColumn("names", F.array(*[F.lit(c) for c in coefficients])).withColumn("attributions", F.array(*parts))


def mood_vectors(interactions: DataFrame, vectors: DataFrame, context: Column, now: Column, length: int = 50) -> DataFrame:
    """Recency-weighted mean item vector per (user, context) over the user's last ``length`` interactions."""
    recent = top_k(interactions.withColumn("context", context), ["user_id"], [F.desc("ts"), F.desc("event_id")], length, "_r")
    weighted = recent.withColumn("weight", freshness_weight(F.col("ts"), now)).join(
        vectors.select("item_id", "embedding"), "item_id")
    return mean_vectors(weighted, ["user_id", "context"], "embedding", "weight").withColumnRenamed("mean_vector", "mood")


def logistic_scores(train: DataFrame, score: DataFrame, inputs: list[str], label: str = "label") -> DataFrame:
    """Probability of ``label`` by logistic regression on numeric inputs.

    The fit passes over its rows several times, so they are written once and whatever made them runs once.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              LogisticRegression(labelCol=label, maxIter=30, regParam=0.01)]
    rows = write_and_read(train, "logistic-rows")
    scored = Pipeline(stages=stages).fit(rows.select(*inputs, label)).transform(rows if score is train else score)
    return scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "raw", "features", "rawPrediction", "prediction")
