"""Time-bucketed aggregates and range queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 24
LEVELS_AT_ONCE = 8


def hour_of_epoch(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def bucket_agg(updates: DataFrame, key: list[str], value: str, mode: str = "add", seq: str = "seq",
               scale: int | None = None) -> DataFrame:
    """Additive update per bucket, or last write wins; ``scale`` stores whole thousandths and the like."""
    v = F.col(value) if scale is None else F.floor(F.col(value) * scale).cast("bigint")
    if mode == "add":
        return updates.groupBy(*key).agg(F.sum(v).alias("value"))
    if mode == "set":
        return updates.groupBy(*key).agg(F.max_by(v, F.col(seq)).alias("value"))
    raise ValueError(f"unknown mode {mode!r}")


def dyadic_pieces(lo: Column, hi: Column, levels: int = LEVELS) -> Column:
    """Cover ``[lo, hi)`` with aligned blocks of 2**level buckets: at most two a level, and all that is left at the highest one.

    An empty range has none.
    """
    def piece(level: int, bucket: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), bucket.cast("bigint").alias("bucket"))

    ends = []
    for level in range(levels):
        a, b = _up(lo, level), F.shiftright(hi, level)
        ends += [F.when((a < b) & (a.bitwiseAND(F.lit(1)) == 1), piece(level, a)),
                 F.when((a < b) & (b.bitwiseAND(F.lit(1)) == 1), piece(level, b - 1))]
    a, b = _up(lo, levels), F.shiftright(hi, levels)
    top = F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: piece(levels, x))).otherwise(
        F.array().cast("array<struct<level:int,bucket:bigint>>"))
    return F.concat(F.array_compact(F.array(*ends)), top)


def _up(x: Column, level: int) -> Column:
    """x / 2**level, rounded up."""
    return -F.shiftright(-x, level)


def dyadic_tree(fine: DataFrame, merges: dict, levels: int = LEVELS) -> DataFrame:
    """(level, bucket, values) of every block that holds a row of ``fine(bucket, values)``.

    One shuffle makes ``LEVELS_AT_ONCE`` levels from the highest one before, which has 2**LEVELS_AT_ONCE times fewer rows.
    """
    tree, base, base_level = fine.withColumn("level", F.lit(0)), fine, 0
    while base_level < levels:
        step = min(LEVELS_AT_ONCE, levels - base_level)
        up = base.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(step))))
        made = up.groupBy((F.col("up") + base_level).alias("level"), F.expr("shiftright(bucket, up)").alias("bucket")).agg(
            *[m(F.col(n)).alias(n) for n, m in merges.items()])
        tree = tree.unionByName(made)
        base_level += step
        base = made.filter(F.col("level") == base_level).drop("level")
    return tree


def range_agg(buckets: DataFrame, ranges: DataFrame, aggs: dict[str, tuple], default: float | dict = 0.0, levels: int = LEVELS) -> DataFrame:
    """Aggregates over half-open bucket ranges of any length; empty ranges give ``default`` (a dict: by name, else null).

    ``buckets(bucket, value)``, ``ranges(range_id, lo, hi)``; ``aggs`` maps a name to ``(partial, merge)`` Column functions, e.g.
    ``(F.sum, F.sum)``. ``merge`` may be any associative function; one that depends on the order carries it in its values, as the first
    value does with ``(lambda v: F.min(F.struct("bucket", v)), F.min)``. Ranges are cut into blocks of a dyadic tree, so the join is
    an equi-join and a range of n buckets touches at most 2 * log2(n) rows (more only beyond 2**levels buckets).
    """
    fine = buckets.withColumn("bucket", F.col("bucket").cast("bigint")).groupBy("bucket").agg(
        *[p(F.col("value")).alias(n) for n, (p, _) in aggs.items()])
    tree = dyadic_tree(fine, {n: m for n, (_, m) in aggs.items()}, levels)
    pieces = ranges.select("range_id", F.inline_outer(dyadic_pieces(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), levels)))
    joined = pieces.join(tree, ["level", "bucket"], "left")
    fallback = default if isinstance(default, dict) else dict.fromkeys(aggs, default)
    merged = {n: m(F.col(n)) for n, (_, m) in aggs.items()}
    return joined.groupBy("range_id").agg(
        *[(F.coalesce(c, F.lit(fallback[n])) if n in fallback else c).alias(n) for n, c in merged.items()])


def window_total(df: DataFrame, key: list[str], value: str, start: Column, end: Column) -> DataFrame:
    inside = df.filter((F.col("ts") >= start) & (F.col("ts") < end))
    return inside.groupBy(*key).agg(F.sum(value).alias("total"))


def rolling_days(daily: DataFrame, key: list[str], value: str, days: int) -> DataFrame:
    """Sum over the ``days`` days before each day (the day itself excluded).

    Rows are pre-aggregated per key and day, so even a hot key has one row per day.
    """
    per_day = daily.groupBy(*key, "day").agg(F.sum(value).alias(value))
    number = F.unix_date("day")
    w = Window.partitionBy(*key).orderBy(number).rangeBetween(-days, -1)
    return per_day.withColumn("rolling", F.coalesce(F.sum(value).over(w), F.lit(0)))
