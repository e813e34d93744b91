"""Message envelopes: decoding, routing with a dead-letter side, and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.schemas import PAYLOADS


def kafka_stream(spark: SparkSession, servers: str, topics: list[str] = S.TOPICS, per_trigger: int = 500) -> DataFrame:
    """Kafka source as envelope rows; needs the connector on the classpath of the cluster."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", ",".join(topics)).option("startingOffsets", "latest")
           .option("maxOffsetsPerTrigger", per_trigger).load())
    return raw.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")


def decode(envelopes: DataFrame, topic: str) -> DataFrame:
    """Typed payload rows of one topic; ``is_corrupt`` marks values that do not parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = envelopes.filter(F.col("topic") == topic).withColumn(
        "payload", F.from_json("value", PAYLOADS[topic], options))
    return parsed.withColumn("is_corrupt", F.col("payload").isNull() | F.col("payload._corrupt_record").isNotNull())


def good_rows(envelopes: DataFrame, topic: str) -> DataFrame:
    carried = [c for c in ("partition", "offset") if c in envelopes.columns]
    fields = [f for f in _fields(topic) if f != "timestamp"]
    micros = F.timestamp_micros(F.round(F.col("payload.timestamp") * F.lit(1e6)).cast("bigint"))
    return decode(envelopes, topic).filter("NOT is_corrupt").select(
        "key", *carried, F.coalesce(micros, "timestamp").alias("ts"),
        *[F.col(f"payload.{f}").alias(f) for f in fields])


def _fields(topic: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(PAYLOADS[topic]) if f.name != "_corrupt_record"]


def dead_letters(envelopes: DataFrame, topics: list[str] = S.TOPICS) -> DataFrame:
    """Values that no topic can read: unknown topic or broken payload. Good rows keep flowing."""
    unknown = envelopes.filter(~F.col("topic").isin(topics)).withColumn("reason", F.lit("unknown topic"))
    out = unknown.select("topic", "key", "value", "timestamp", "reason")
    for topic in topics:
        broken = decode(envelopes, topic).filter("is_corrupt").withColumn("reason", F.lit("unreadable value"))
        out = out.unionByName(broken.select("topic", "key", "value", "timestamp", "reason"))
    return out


def route(envelopes: DataFrame) -> DataFrame:
    """(topic, outcome, key, timestamp) with outcome ``ok``, ``unreadable value`` or ``unknown topic``.

    One pass over the envelopes: each row is parsed with its own topic's schema only.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    broken = F.lit(None).cast("boolean")
    for topic in S.TOPICS:
        payload = F.from_json("value", PAYLOADS[topic], options)
        broken = F.when(F.col("topic") == topic, payload.isNull() | payload["_corrupt_record"].isNotNull()).otherwise(broken)
    outcome = F.when(broken.isNull(), "unknown topic").when(broken, "unreadable value").otherwise("ok")
    return envelopes.select("topic", outcome.alias("outcome"), "key", "timestamp")


def encode_event(event: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Event rows -> envelope keyed by user; ``metadata`` (map of variants) flattens over the base keys."""
    base = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string").cast("variant"),
        F.lit("event_type"), F.col("event_type").cast("variant"),
        F.lit("item_id"), F.col("item_id").cast("string").cast("variant"),
        F.lit("timestamp"), (F.unix_micros("ts") / F.lit(1e6)).cast("variant"))
    flat = base
    if metadata is not None:
        keys = F.map_keys(metadata)
        flat = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(keys, k)), metadata)
    return event.select(F.lit("user-events").alias("topic"), F.col("user_id").cast("string").alias("key"),
                        F.to_json(flat).alias("value"), F.col("ts").alias("timestamp"))


def encode_purchase(purchase: DataFrame) -> DataFrame:
    body = F.struct(F.col("user_id").cast("string").alias("user_id"), F.col("item_ids").cast("array<string>").alias("item_ids"),
                    "total_amount", (F.unix_micros("ts") / F.lit(1e6)).alias("timestamp"))
    return purchase.select(F.lit("purchases").alias("topic"), F.col("user_id").cast("string").alias("key"),
                           F.to_json(body).alias("value"), F.col("ts").alias("timestamp"))


def encode(df: DataFrame, topic: str, key: Column, body: Column, ts: Column) -> DataFrame:
    return df.select(F.lit(topic).alias("topic"), key.cast("string").alias("key"), F.to_json(body).alias("value"), ts.alias("timestamp"))
