"""Per-key and global rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank.functions.hashing import md5_60

HASH_SLICES = 4096
GROUP_LIMIT = 1000


def ranked(df: DataFrame, keys: list, order: list[Column], rank_col: str = "rank") -> DataFrame:
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def top_k(df: DataFrame, keys: list, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows per key. Spark limits each partition before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if k > GROUP_LIMIT:
        # Beyond Spark's own limit push-down: cut hashed slices of each key first, then the key itself.
        slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(64))).withColumn(
            "_pre", F.row_number().over(slices)).filter(F.col("_pre") <= k).drop("_slice", "_pre")
    limited = df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return limited.withColumn(rank_col, F.col(rank_col).cast("bigint"))


def global_top_k(df: DataFrame, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Ranks are added to at most k rows, after a distributed top-k."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def sample_per_key(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n pseudo-random rows per key, the same ones on every run."""
    order = [md5_60(*[F.col(k) for k in keys], F.col(id_col), seed), F.col(id_col)]
    return top_k(df, keys, order, n, "sample_rank")


def dense_index(df: DataFrame, id_col: str, index_col: str = "idx") -> DataFrame:
    """0-based dense index in hash order without a single-task window.

    Ids are cut into fixed hash slices; each slice is numbered on its own and shifted by the
    size of the slices before it. The slice table has at most HASH_SLICES rows.
    """
    hashed = df.withColumn("_h", md5_60(F.col(id_col))).withColumn(
        "_slice", F.shiftright("_h", 60 - HASH_SLICES.bit_length() + 1)
    )
    sizes = hashed.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_slice").orderBy("_h", id_col)
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_slice")
        .withColumn(index_col, F.col("_offset") + F.col("_rn") - 1)
        .drop("_h", "_slice", "_rn", "_offset")
    )


def rerank(df: DataFrame, key: str, score: Column, item: str = "item_id", score_col: str = "score",
           k: int | None = None, digits: int = 9) -> DataFrame:
    """Replace the score and rank again; ties go to the smaller item id."""
    scored = df.withColumn(score_col, F.round(score, digits))
    order = [F.desc(score_col), F.asc(item)]
    return ranked(scored, [key], order) if k is None else top_k(scored, [key], order, k)
