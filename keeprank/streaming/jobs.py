"""Streaming operators. Each takes streaming DataFrames and returns one; the caller picks mode and sink."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keeprank import settings as S
from keeprank.functions import scoring


def hourly_counts(events: DataFrame, keys: list[str], value: str, delay: str = "2 hours") -> DataFrame:
    """Tumbling one-hour counts and sums per key (update or append mode)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("hour"), *keys, "n", "total")


def sliding_days(events: DataFrame, keys: list[str], value: str, days: int = 7, delay: str = "2 hours") -> DataFrame:
    """N-day windows sliding hourly, fed by one-hour partial sums (append mode).

    The first aggregation shrinks the stream to one row per key and hour, so only those rows fan out into
    the overlapping windows.
    """
    hourly = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"))
    return hourly.groupBy(F.window(F.window_time("window"), f"{days} days", "1 hour").alias("span"), *keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).select(
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "n", "total")


def match_returns(purchases: DataFrame, returns: DataFrame, keys: list[str], days: int = S.RETURN_WINDOW_DAYS,
                  delay: str = "1 day") -> DataFrame:
    """Purchases left-joined with their return inside the window; kept purchases come out after the watermark."""
    left = purchases.withWatermark("purchase_ts", delay).alias("p")
    right = returns.withWatermark("return_ts", delay).alias("r")
    match = F.expr(" AND ".join([f"p.{k} = r.{k}" for k in keys] + [
        "r.return_ts >= p.purchase_ts", f"r.return_ts <= p.purchase_ts + INTERVAL {days} DAYS"]))
    return left.join(right, match, "leftOuter").select(
        *[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.purchase_ts"), F.col("r.return_ts"))


def regret_profile(purchases: DataFrame) -> DataFrame:
    """Running segment counts (update mode)."""
    return purchases.groupBy(scoring.segment_key(F.col("category"), F.col("price")).alias("segment")).agg(
        F.count("*").alias("num_purchases"), F.count("return_ts").alias("num_returns"),
        F.sum(F.coalesce("regret_rating", F.lit(0))).alias("regret_sum"))


def stale_keys(purchases: DataFrame) -> DataFrame:
    """Recommendation keys that a purchase ``(user_id, item_ids)`` makes stale."""
    user = F.col("user_id").cast("string")
    per_item = F.transform("item_ids", lambda i: F.concat(F.lit("recs:"), user, F.lit(":"), i.cast("string")))
    return purchases.select(F.explode(F.concat(F.array(F.concat(F.lit("recs:"), user), user), per_item)).alias("key"))


def dedup_within(events: DataFrame, keys: list[str], delay: str = "4 hours") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class SeenSlots(StatefulProcessor):
    """Whether an item was met in the current or the previous slots; state is the last slot of each item that still counts.

    A timer at the end of the newest slot that counts drops what an event at or after the watermark can no longer need.
    """

    def __init__(self, slots: int, slot_seconds: int):
        self.slots, self.slot_seconds = slots, slot_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item_id BIGINT, slot BIGINT")

    def keep(self, kept: dict, watermark_ms: int) -> None:
        floor = watermark_ms // (self.slot_seconds * 1000) - self.slots
        kept = {item: int(slot) for item, slot in kept.items() if slot > floor}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not kept:
            self.items.clear()
            return
        self.items.put(list(kept.items()))
        oldest = (min(kept.values()) + self.slots) * self.slot_seconds * 1000
        self.handle.registerTimer(max(oldest, watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues):
        kept = dict(self.items.get())
        pdf = pd.concat(list(rows)).sort_values(["item_id", "ts", "event_id"])
        slot = pdf["ts"].astype("datetime64[s]").astype("int64") // self.slot_seconds
        before = slot.groupby(pdf["item_id"]).shift(1)
        before = before.fillna(pdf["item_id"].map(kept)).astype("float64")
        newest = slot.groupby(pdf["item_id"]).max()
        kept.update({item: max(s, kept.get(item, s)) for item, s in newest.to_dict().items()})
        self.keep(kept, timerValues.getCurrentWatermarkInMs())
        seen = (slot - before).between(0, self.slots - 1)
        yield pd.DataFrame({"event_id": pdf["event_id"], "slot": slot, "seen_recently": seen.astype(bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.keep(dict(self.items.get()), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def seen_items(events: DataFrame, slots: int = 4, slot_seconds: int = 3600, delay: str = "1 hour", parts: int = 4) -> DataFrame:
    """Slot-exact check whether (user, item) was met in the current or the previous ``slots - 1`` slots.

    State is kept per user and item part (few groups with vectorised work in each, and a busy user is still
    split) and expires by event time.
    """
    split = events.withWatermark("ts", delay).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    return split.groupBy("user_id", "part").transformWithStateInPandas(
        SeenSlots(slots, slot_seconds), "event_id BIGINT, slot BIGINT, seen_recently BOOLEAN", "append", "EventTime")


def latest(updates: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """Newest values per key (update mode)."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(key, "_v.*")


def divergence(steps: DataFrame, window: int = S.DIVERGENCE_WINDOW, threshold: float = S.DIVERGENCE_THRESHOLD) -> DataFrame:
    """Rolling mean of the last ``window`` divergences per (user, cohort) pair, with the alarm flag."""

    def roll(key, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values("seq")
        past = list(state.get[0]) if state.exists else []
        rows = []
        for seq, value in zip(pdf["seq"], pdf["divergence"]):
            past = [*past, float(value)][-window:]
            mean = sum(past) / len(past)
            rows.append((key[0], key[1], int(seq), mean, mean > threshold))
        state.update((past,))
        yield pd.DataFrame(rows, columns=["user_id", "ref_id", "seq", "mean_divergence", "alarm"])

    return steps.groupBy("user_id", "ref_id").applyInPandasWithState(
        roll, "user_id BIGINT, ref_id BIGINT, seq BIGINT, mean_divergence DOUBLE, alarm BOOLEAN",
        "recent ARRAY<DOUBLE>", "append", GroupStateTimeout.NoTimeout)


def fraud_alerts(purchases: DataFrame, days: int = 90, min_rows: int = 5, threshold: float = S.FRAUD_SUSPECT) -> DataFrame:
    """Sellers whose share of returned purchases in a window reaches the threshold (update mode)."""
    windowed = purchases.withWatermark("ts", "1 day").groupBy(F.window("ts", f"{days} days"), "seller_id").agg(
        F.count("*").alias("n"), F.count_if("is_returned").alias("returned"))
    scored = windowed.withColumn("probability", F.col("returned") / F.col("n"))
    return scored.filter((F.col("n") >= min_rows) & (F.col("probability") >= threshold)).select(
        F.col("window.start").alias("start"), "seller_id", "n", "probability")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap (append mode)."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
