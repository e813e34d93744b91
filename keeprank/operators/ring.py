"""Stable shard assignment of keys on a hash ring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.functions.hashing import HASH_BITS, md5_60
from keeprank.session import small_table

CELL_BITS = 12
SPAN = 1 << HASH_BITS


def virtual_nodes(spark: SparkSession, shards: list[int], per_shard: int = S.VIRTUAL_NODES) -> DataFrame:
    """(shard, vnode, h); its size is fixed by the two parameters, not by the data."""
    ids = small_table(spark, [(int(s),) for s in shards], "shard BIGINT")
    spread = ids.withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(per_shard - 1))))
    return spread.withColumn("h", md5_60(F.col("shard"), F.col("vnode")))


def ring_arcs(nodes: DataFrame, replicas: int = 1) -> DataFrame:
    """Half-open arcs ``[lo, hi)`` with the owners met clockwise from the arc.

    A key belongs to the next virtual node; the arc past the last node wraps to the first.
    """
    pos = Window.orderBy("h", "shard")
    whole = pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = pos.rowsBetween(0, replicas - 1)
    first = F.slice(F.collect_list("shard").over(whole), 1, replicas)
    placed = nodes.select(
        "h", "shard", F.lag("h").over(pos).alias("prev"), F.collect_list("shard").over(ahead).alias("near"),
        first.alias("start"), F.max("h").over(whole).alias("last"), F.min("h").over(whole).alias("low"))
    owners = F.array_distinct(F.slice(F.concat("near", "start"), 1, replicas))
    inner = placed.select(F.coalesce("prev", F.lit(0)).alias("lo"), F.col("h").alias("hi"), owners.alias("owners"))
    wrap = placed.filter("h = low").select(
        F.col("last").alias("lo"), F.lit(SPAN).alias("hi"), F.array_distinct("start").alias("owners"))
    return inner.unionByName(wrap).filter("lo < hi")


def assign(keys: DataFrame, arcs: DataFrame, key: str) -> DataFrame:
    """Interval lookup as an equi-join on the top hash bits with the interval as residual."""
    shift = HASH_BITS - CELL_BITS
    cells = F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))
    table = arcs.withColumn("cell", F.explode(cells))
    hashed = keys.withColumn("_h", md5_60(F.col(key))).withColumn("cell", F.shiftright("_h", shift))
    hit = hashed.join(table, (hashed.cell == table.cell) & (hashed["_h"] >= table.lo) & (hashed["_h"] < table.hi))
    return hit.select(*[hashed[c] for c in keys.columns], "owners")


def assign_shard(keys: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    return assign(keys, ring_arcs(nodes), key).select(*keys.columns, F.get("owners", F.lit(0)).alias("shard"))


def assign_replicas(keys: DataFrame, nodes: DataFrame, key: str, replicas: int = S.REPLICAS) -> DataFrame:
    return assign(keys, ring_arcs(nodes, replicas), key)


def reshard_diff(keys: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that move; both rings are looked up from the same rows, so keys are not joined to themselves."""
    old = assign_shard(keys, before, key).withColumnRenamed("shard", "old_shard")
    both = assign_shard(old, after, key).withColumnRenamed("shard", "new_shard")
    return both.filter("old_shard <> new_shard")


def ring_load(nodes: DataFrame) -> DataFrame:
    """Fraction of the ring owned per shard (the arc in front of each virtual node)."""
    return ring_arcs(nodes).groupBy(F.get("owners", F.lit(0)).alias("shard")).agg(
        (F.sum((F.col("hi") - F.col("lo")).cast("double")) / F.lit(float(SPAN))).alias("load"))


def node_gaps(nodes: DataFrame) -> DataFrame:
    """Distance from every virtual node to the next one, with wrap."""
    pos = Window.orderBy("h", "shard")
    whole = pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead("h").over(pos), F.min("h").over(whole) + F.lit(SPAN))
    return nodes.withColumn("gap", nxt - F.col("h"))
