"""Interaction log: reading, validated append, and the feature/recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keeprank.functions.scoring import expires_at
from keeprank.schemas import EVENT_TYPES, INTERACTION
from keeprank.session import pin_utc


def load_interactions(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = INTERACTION,
                      since: str | None = None, date_col: str = "ts", **options) -> DataFrame:
    """Read a log with a declared schema; ``since`` becomes a pushed-down (or partition) filter."""
    reader = pin_utc(spark).read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df if since is None else df.filter(F.col(date_col) >= F.lit(since).cast(df.schema[date_col].dataType))


def validate_events(events: DataFrame, allowed: list[str] = EVENT_TYPES) -> DataFrame:
    """Add ``reject_reason`` (null for a valid row)."""
    reason = (
        F.when(F.col("user_id").isNull(), "user_id missing")
        .when(F.col("item_id").isNull(), "item_id missing")
        .when(F.col("event_type").isNull(), "event_type missing")
        .when(~F.col("event_type").isin(allowed), "event_type not allowed")
    )
    return events.withColumn("reject_reason", reason)


def ingest_events(events: DataFrame, path: str, rejects_path: str, ts: str = "ts") -> None:
    """Append valid rows partitioned by day; rejected rows are kept with their reason."""
    checked = validate_events(events)
    (checked.filter("reject_reason IS NULL").drop("reject_reason")
     .withColumn("event_date", F.to_date(ts)).repartition("event_date", F.pmod(F.xxhash64("user_id"), F.lit(16)))
     .write.mode("append").partitionBy("event_date").parquet(path))
    checked.filter("reject_reason IS NOT NULL").write.mode("append").parquet(rejects_path)


def save_training_data(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def materialise_recs(recs: DataFrame, path: str, now: Column, ttl_seconds: int = 60) -> None:
    """Ranked rows per (user, surface) with their expiry, partitioned by surface."""
    (recs.withColumn("expires_at", expires_at(now, ttl_seconds))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("surface").parquet(path))


def drop_stale(table: DataFrame, stale: DataFrame, key: str = "key") -> DataFrame:
    """Remove the rows whose key is listed."""
    return table.join(stale.select(key).distinct(), key, "left_anti")


def drop_matching(table: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Remove keys by a glob pattern with ``*`` as wildcard."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return table.filter(~F.col(key).like(like))
