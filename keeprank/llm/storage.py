"""Intermediate tables in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from keeprank.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each write ends, as nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def put(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` to ``path`` as Parquet and read it back with its schema."""
    spark = df.sparkSession
    with freed_shuffles(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, **options) -> DataFrame:
    """An intermediate table, so that what follows survives lost executors and computes nothing twice."""
    return put(df, scratch_path(df.sparkSession, name), **options)
