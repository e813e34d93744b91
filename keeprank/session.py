"""Session helpers: a test session, UTC pinning, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster passes its own session in."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("keeprank")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Hours, weekdays and epoch seconds are all defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a fresh temporary folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.conf.get("keeprank.scratch.dir", None)
    if not known:
        known = tempfile.mkdtemp(prefix="spark-keeprank-", dir="/tmp")
        spark.conf.set("keeprank.scratch.dir", known)
    return known


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant dimension table as a local relation, so its exact size is known to the optimizer."""
    names = [part.split()[0] for part in schema.split(",")]
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows])
    return spark.createDataFrame(table, schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so iterative jobs survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Materialise an intermediate as a parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
