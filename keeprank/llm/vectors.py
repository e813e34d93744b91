"""What the two vector operators share: reading, row checks, hashed dealing and stacking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def dealt(column: str, parts: Column | int, seed: int = 0) -> Column:
    """Bucket of a row by the hash of its id; equal ids meet in one bucket."""
    return F.pmod(F.xxhash64(F.lit(seed), column), parts)


def stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])
