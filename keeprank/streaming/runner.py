"""Running streams to the end of the available input, with every result in the shared folder."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keeprank.schemas import RAW
from keeprank.session import pin_utc, scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROWS_PER_STEP = 4_000_000
# State of a step that has ended goes soon, and one version of it stays instead of two.
SHORT_LIVED = {"spark.sql.streaming.stateStore.maintenanceInterval": "2s", "spark.sql.streaming.maxBatchesToRetainInMemory": "1"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet input, one file or a folder of part files, as a file stream. The pattern lets a single file be a stream's path."""
    reader = pin_utc(spark).readStream.schema(RAW[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def folder_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = pin_utc(spark).readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stage(df: DataFrame, name: str) -> str:
    """Write derived rows that a stream will read."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which states with timers and time to live need."""
    return settings(spark, {STATE_STORE: ROCKSDB})


def drain(writer, name: str) -> None:
    """Run a stream over all input that is there now."""
    query = writer.trigger(availableNow=True).queryName(f"{name}_{time.time_ns()}").start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_append(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Append-mode run into parquet; returns the finished rows. A run with the ``base`` folder of an earlier one goes on from there."""
    spark = stream.sparkSession
    out, log = (f"{base}/rows", f"{base}/log") if base else (scratch_path(spark, name), scratch_path(spark, f"{name}-log"))
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log), name)
    return spark.read.schema(stream.schema).parquet(out)


def time_cuts(tables: list[tuple[DataFrame, str]], rows_per_step: int) -> list:
    """Times that cut the rows of all tables together into steps of about ``rows_per_step`` rows; none for a small input."""
    days = None
    for table, time_col in tables:
        own = table.select(F.date_trunc("day", time_col).alias("day"))
        days = own if days is None else days.unionByName(own)
    # At most one row per day comes to the driver.
    counts, cuts, filled = sorted(days.filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n")).collect()), [], 0
    for day, n in counts:
        if filled and filled + n > rows_per_step:
            cuts, filled = [*cuts, day], 0
        filled += n
    return cuts


def run_in_order(ends: list[tuple[DataFrame, str, list]], build: Callable[..., DataFrame], name: str, rows_per_step: int = ROWS_PER_STEP) -> DataFrame:
    """Append-mode run of ``build(*streams)`` over tables that arrive in the order of their times, one step of about ``rows_per_step`` rows after the other.

    ``ends`` holds (table, time column, sentinel row) each. As the watermark follows the steps, the state holds what it still covers, however
    long the tables are; every step goes on from the checkpoint of the one before. No row is late: a step starts where the one before ended. The
    sentinels, far in the future, close the last step. Rows without a time come with the first one.
    """
    spark = ends[0][0].sparkSession
    cuts = time_cuts([(table, time_col) for table, time_col, _ in ends], rows_per_step)
    folders = []
    for k, (table, time_col, sentinel) in enumerate(ends):
        step = F.lit(0)
        for at, cut in enumerate(cuts, 1):
            step = F.when(F.col(time_col) >= F.lit(cut), F.lit(at)).otherwise(step)
        path = scratch_path(spark, f"{name}-steps-{k}")
        # As many tasks a step as write it anyway; a step's files are read alone, where they are.
        table.withColumn("run_step", step).write.partitionBy("run_step").parquet(path)
        loose = StructType([StructField(f.name, f.dataType, True) for f in table.schema])
        last = spark.createDataFrame([tuple(sentinel)], loose).coalesce(1)
        for at in range(len(cuts) + 1):
            # The folder of a step without rows has to be there as well.
            (last if at == len(cuts) else last.limit(0)).write.mode("append").parquet(f"{path}/run_step={at}")
        folders.append(path)
    base = scratch_path(spark, name)
    for at in range(len(cuts) + 1):
        # By a pattern, since a stream may then read another folder than the step before it.
        steps = [folder_stream(spark, f"{path}/[r]un_step={at}", StructType([*end[0].schema.fields, StructField("run_step", LongType())])).drop(
            "run_step") for path, end in zip(folders, ends)]
        with settings(spark, SHORT_LIVED):
            out = run_append(build(*steps), name, base)
    return out


def run_batches(stream: DataFrame, name: str, handler, mode: str = "append", log: str | None = None) -> None:
    """``handler(batch_df, batch_id)`` per micro-batch. A run with the ``log`` folder of an earlier one goes on from there."""
    log = log or scratch_path(stream.sparkSession, f"{name}-log")
    drain(stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(handler), name)


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Update-mode run; returns the last value of every key.

    Each batch overwrites its own folder, so a retried batch leaves no duplicates.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    # The folder is there before the stream, which saves nothing if there is no input.
    saved = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], saved).write.parquet(f"{out}/part=-1")
    run_batches(stream, name, save, "update")
    rest = [c for c in stream.columns if c not in keys]
    table = spark.read.schema(saved).parquet(out)
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_row"))
    return newest.select(*keys, "_row.*")
