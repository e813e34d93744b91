"""Feature tables: vectors, histories, sequences, lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.operators.ranking import top_k
from keeprank.session import write_and_read

BLOCK_PAIRS = 400_000
BLOCK_ITEMS = 4_096
STEP_PAIRS = 65_536


def mean_vectors(df: DataFrame, key, vector: str = "embedding", weight: str | None = None, dim: int | None = None) -> DataFrame:
    """(Weighted) mean vector per key with a JVM aggregate; map-side combine keeps hot keys small.

    With a known small ``dim`` the mean is one plain average per position, which stays in generated code.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if dim is not None and weight is None:
        means = [F.avg(F.get(vector, F.lit(i))).alias(f"_m{i}") for i in range(dim)]
        return df.filter(F.col(vector).isNotNull()).groupBy(*keys).agg(*means).select(
            *keys, F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("mean_vector"))
    col = array_to_vector(F.col(vector))
    mean = Summarizer.mean(col) if weight is None else Summarizer.mean(col, F.col(weight))
    return df.filter(F.col(vector).isNotNull()).groupBy(*keys).agg(vector_to_array(mean).alias("mean_vector"))


def mean_of_items(pairs: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, mean_vector) over the distinct items of ``pairs(key, item_id)`` that have vectors.

    Keys and items are cut into blocks by hash; a pair of blocks gets the ids of its pairs and the vectors of its items once
    and returns a sum per key, so no pair ever carries a vector through a shuffle.
    """
    kind = pairs.schema[key].dataType.simpleString()
    pairs = write_and_read(pairs.select(F.col(key).alias("key"), "item_id").distinct(), "pairs")
    held = vectors.filter(F.col(vector).isNotNull()).select("item_id", F.col(vector).cast("array<double>").alias("vec"))
    n_keys, n_items = max(1, -(-pairs.count() // BLOCK_PAIRS)), max(1, -(-held.count() // BLOCK_ITEMS))
    item_block = F.pmod(F.xxhash64("item_id"), F.lit(n_items)).alias("item_block")
    asked = pairs.select("*", F.pmod(F.xxhash64("key"), F.lit(n_keys)).alias("key_block"), item_block)
    copies = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_keys - 1).cast("bigint"))).alias("key_block"), item_block)

    def sums(asked: pa.Table, held: pa.Table) -> pa.Table:
        items = held.column("item_id").combine_chunks().dictionary_encode()
        vec = held.column("vec").combine_chunks()
        rows = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))
        matrix, copies = np.zeros((len(items.dictionary), rows.shape[1])), np.bincount(items.indices, minlength=len(items.dictionary))
        np.add.at(matrix, items.indices.to_numpy(), rows)
        place = pc.index_in(asked.column("item_id"), items.dictionary).combine_chunks()
        found = place.is_valid()
        keys = asked.column("key").combine_chunks().filter(found).dictionary_encode(null_encoding="encode")
        place, code = place.filter(found).to_numpy(), keys.indices.to_numpy()
        order = np.lexsort((place, code))
        place, code = place[order], code[order]
        total = np.zeros((len(keys.dictionary), matrix.shape[1]))
        for lo in range(0, len(code), STEP_PAIRS):
            some = code[lo:lo + STEP_PAIRS]
            starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            total[some[starts]] += np.add.reduceat(matrix[place[lo:lo + STEP_PAIRS]], starts)
        n = np.bincount(code, weights=copies[place], minlength=len(total))
        lists = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * matrix.shape[1], pa.array(total.ravel()))
        block = pa.array(np.full(len(total), held.column("item_block")[0].as_py() if len(held) else 0, dtype=np.int64))
        return pa.table({"key": keys.dictionary, "n": pa.array(n), "total": lists, "item_block": block})

    keys = ["key_block", "item_block"]
    part = asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
        sums, f"key {kind}, n double, total array<double>, item_block bigint")
    if n_items > 1:
        added = lambda a, b: F.coalesce(F.zip_with(a, b["total"], lambda x, y: x + y), b["total"])
        part = part.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("item_block", "total"))).alias("parts")).select(
            "key", "n", F.aggregate("parts", F.lit(None).cast("array<double>"), added).alias("total"))
    return part.select(F.col("key").alias(key), F.transform("total", lambda v: v / F.col("n")).alias("mean_vector"))


def time_metadata(ts: Column) -> Column:
    weekday = F.weekday(ts)
    return F.create_map(
        F.lit("hour_of_day"), F.hour(ts).cast("double"),
        F.lit("day_of_week"), weekday.cast("double"),
        F.lit("is_weekend"), (weekday >= 5).cast("double"))


def user_history(seen: DataFrame) -> DataFrame:
    """Distinct (user_id, category) in long form."""
    return seen.select("user_id", "category").distinct()


def category_affinity(seen: DataFrame) -> DataFrame:
    return seen.groupBy("user_id", "category").agg(F.count("*").cast("double").alias("affinity"))


def merge_affinity_maps(a: Column, b: Column) -> Column:
    """Additive merge of two affinity maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def context_overlap(seen: DataFrame, k: int = 5) -> DataFrame:
    """Jaccard of a user's top-k categories between every two of the (at most seven) contexts."""
    counts = seen.groupBy("user_id", "context", "category").agg(F.count("*").alias("n"))
    tops = top_k(counts, ["user_id", "context"], [F.desc("n"), F.asc("category")], k)
    sets = tops.groupBy("user_id", "context").agg(F.collect_set("category").alias("cats"))
    per_user = sets.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("context", "cats"))).alias("all"))
    a = per_user.select("user_id", "all", F.posexplode("all").alias("pos", "a"))
    b = a.select("user_id", "a", F.explode(F.slice("all", F.col("pos") + 2, F.size("all"))).alias("b"))
    inter, union = F.array_intersect("a.cats", "b.cats"), F.array_union("a.cats", "b.cats")
    return b.select(
        "user_id", F.col("a.context").alias("context_a"), F.col("b.context").alias("context_b"),
        F.round(F.size(inter) / F.size(union), 6).alias("overlap"))


def interaction_sequence(interactions: DataFrame, payday: Column, length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """Last ``length`` interactions per user, oldest first, as an array of step structs."""
    recent = top_k(interactions, ["user_id"], [F.desc("ts"), F.desc("event_id")], length, "recency")
    weekday = F.weekday("ts")
    step = F.struct(
        "ts", "event_id", "item_id", "event_type", F.hour("ts").alias("hour"), weekday.alias("weekday"),
        (weekday >= 5).cast("int").alias("is_weekend"), payday.cast("int").alias("is_payday"))
    return recent.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def latest_features(updates: DataFrame, keys: list[str], ttl: Column) -> DataFrame:
    """Newest row per key plus its expiry. ``updates`` carries ``ts`` and a tie-breaking ``version``."""
    rest = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "version")).alias("row"))
    return newest.select(*keys, "row.*").withColumn("expires_at", F.col("ts") + ttl)


def feature_lookup(entities: DataFrame, views: dict[str, DataFrame], refs: list[str], key: str) -> DataFrame:
    """Join ``view:feature`` references onto entity rows; missing rows give null."""
    out = entities
    for view, frame in views.items():
        wanted = [r.split(":", 1)[1] for r in refs if r.split(":", 1)[0] == view]
        if wanted:
            out = out.join(frame.select(key, *[F.col(w).alias(f"{view}__{w}") for w in wanted]), key, "left")
    return out


def feature_asof(events: DataFrame, features: DataFrame, key: str, value: str) -> DataFrame:
    """Feature value known at event time.

    Each entity's log is cut by day: the newest value of every day is carried to the following days through a
    window of one row per day, and only the rows of one day are ordered together. A hot entity is thus many
    small groups.
    """
    updates = features.filter(F.col(value).isNotNull()).select(key, "ts", F.col(value).alias("_value"), F.to_date("ts").alias("_day"))
    asked = events.select(key, "event_id", "ts", F.to_date("ts").alias("_day"))
    newest = updates.groupBy(key, "_day").agg(F.max_by("_value", "ts").alias("_last"))
    days = asked.select(key, "_day").distinct().join(newest, [key, "_day"], "full")
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(key, "_day", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    log = updates.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    today = Window.partitionBy(key, "_day").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("_today", F.last("_value", ignorenulls=True).over(today)).filter("_kind = 1")
    return seen.join(carried, [key, "_day"], "left").select(
        key, "event_id", "ts", F.coalesce("_today", "_carry").alias(value))
