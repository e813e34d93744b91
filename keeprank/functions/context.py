"""Time-context rules and the dimension tables that hang off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keeprank.session import small_table

# Contexts with (price tolerance, impulse, discovery affinity).
CONTEXT_SCALARS = {
    "post_payday": (0.4, 0.6, 0.4),
    "late_night": (0.2, 0.7, 0.5),
    "emotional_comfort": (0.3, 0.5, 0.3),
    "weekend_leisure": (0.15, 0.3, 0.7),
    "workday_lunch": (-0.1, 0.2, 0.1),
    "default": (0.0, 0.1, 0.2),
    "holiday": (0.0, 0.0, 0.0),
}

# Category shifts per context, engine flavour.
ENGINE_SHIFTS = {
    "post_payday": {"electronics": 0.3, "luxury": 0.4, "home": 0.2, "apparel": 0.15},
    "late_night": {"entertainment": 0.4, "food": 0.3, "books": 0.2, "wellness": 0.1},
    "weekend_leisure": {"outdoor": 0.3, "sports": 0.2, "hobbies": 0.3, "travel": 0.2},
    "emotional_comfort": {"comfort_food": 0.4, "entertainment": 0.3, "self_care": 0.3},
    "workday_lunch": {"food": 0.3, "office": 0.2, "productivity": 0.2},
}

# Category shifts per context, serving flavour.
SERVING_SHIFTS = {
    "post_payday": {"electronics": 0.3, "jewelry": 0.4, "home": 0.2, "apparel": 0.15},
    "late_night": {"books": 0.4, "food": 0.3, "music": 0.2, "health": 0.1},
    "weekend_leisure": {"sports": 0.3, "garden": 0.3, "toys": 0.2, "automotive": 0.2},
    "emotional_comfort": {"beauty": 0.4, "food": 0.3, "books": 0.3},
    "workday_lunch": {"food": 0.3, "office": 0.2, "books": 0.2},
    "default": {"apparel": 0.2, "home": 0.2, "electronics": 0.2, "books": 0.2},
}

# Signal categories that count as comfort seeking.
COMFORT_SIGNALS = ["comfort", "self_care", "wellness", "entertainment"]

# Implicit ratings of event types.
EVENT_RATINGS = {"view": 1.0, "click": 1.0, "cart": 3.0, "add_to_cart": 3.0, "purchase": 5.0}


def implicit_rating(event_type: Column, explicit: Column | None = None) -> Column:
    """An explicit rating passes through; otherwise the event type decides, unknown types give 0."""
    rating = F.lit(0.0)
    for name, value in EVENT_RATINGS.items():
        rating = F.when(event_type == name, F.lit(value)).otherwise(rating)
    return rating if explicit is None else F.coalesce(explicit.cast("double"), rating)


def comfort_strength(signals: Column, comfort: list[str] = COMFORT_SIGNALS) -> Column:
    """Sum of the map values whose key is a comfort signal."""
    picked = F.map_values(F.map_filter(signals, lambda k, _: k.isin(comfort)))
    return F.aggregate(picked, F.lit(0.0), lambda acc, v: acc + v)


def emotional_context(
    hour: Column,
    weekday: Column,
    is_payday: Column,
    comfort: Column | None = None,
    variant: str = "engine",
) -> Column:
    """Context label; ``weekday`` counts from Monday = 0, null hour means noon, null weekday Monday.

    ``engine``: weekend from 10 h, lunch = weekday 7-17 h. ``serving``: weekend 10-20 h, lunch 11-13 h.
    """
    h, d = F.coalesce(hour, F.lit(12)), F.coalesce(weekday, F.lit(0))
    weekend = d >= 5
    if variant == "engine":
        leisure, lunch = weekend & (h >= 10), ~weekend & h.between(7, 17)
    elif variant == "serving":
        leisure, lunch = weekend & h.between(10, 20), ~weekend & h.between(11, 13)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    label = F.when(F.coalesce(is_payday, F.lit(False)), "post_payday")
    if comfort is not None:
        label = label.when(comfort > 0.5, "emotional_comfort")
    return (
        label.when((h < 6) | (h >= 23), "late_night")
        .when(leisure, "weekend_leisure")
        .when(lunch, "workday_lunch")
        .otherwise("default")
    )


def context_of(ts: Column, is_payday: Column | None = None, variant: str = "engine") -> Column:
    return emotional_context(F.hour(ts), F.weekday(ts), F.lit(False) if is_payday is None else is_payday,
                             variant=variant)


def time_window(hour: Column, weekday: Column) -> Column:
    return F.concat_ws(
        "_",
        F.when(weekday < 5, "weekday").otherwise("weekend"),
        F.when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening"),
    )


def context_table(spark: SparkSession) -> DataFrame:
    """Seven rows of behavioural scalars, one per context."""
    rows = [(name, *scalars) for name, scalars in CONTEXT_SCALARS.items()]
    return small_table(spark, rows, "context STRING, price_tolerance DOUBLE, impulse DOUBLE, discovery DOUBLE")


def shift_table(spark: SparkSession, shifts: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(ctx, cat, delta) for ctx, per in shifts.items() for cat, delta in per.items()]
    return small_table(spark, rows, "context STRING, category STRING, delta DOUBLE")


def volatility_profile(requests: DataFrame, has_sequence: Column) -> DataFrame:
    """``requests(user_id, hour, weekday, is_payday, …)`` -> one behavioural profile per row."""
    spark = requests.sparkSession
    labelled = requests.withColumn(
        "context", emotional_context(F.col("hour"), F.col("weekday"), F.col("is_payday"))
    ).withColumn("time_window", time_window(F.col("hour"), F.col("weekday")))
    return labelled.join(context_table(spark), "context", "left").withColumn(
        "confidence", F.when(has_sequence, F.lit(0.7)).otherwise(F.lit(0.3))
    )
