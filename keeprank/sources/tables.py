"""Domain tables derived from the parquet inputs.

Each function returns a lazy DataFrame; joins that a caller does not need are left out
by separate functions rather than by relying on outer-join elimination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keeprank.functions.context import implicit_rating
from keeprank.schemas import RAW
from keeprank.session import pin_utc


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sellers = raw(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()
    return raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.round(F.col("p_retailprice") - 895, 2).alias("price"),
        F.round(1 + 4.0 * (F.col("p_size") - 1) / 49, 1).alias("rating"),
        (F.col("p_partkey") * 37 % 1001).alias("inventory"),
        (F.col("p_partkey") % sellers).alias("seller_id"),
    )


def items_with_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        raw(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(F.count("*").alias("review_count"))
    )
    return (
        items(spark, sf_dir)
        .join(counts, "item_id", "left")
        .withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower("c_mktsegment").alias("user_segment"),
        F.col("c_nationkey").alias("ip_group"),
        F.when(balance < 2000, "high").when(balance < 6000, "medium").otherwise("low").alias("price_sensitivity"),
    )


def purchase_lines(spark: SparkSession, sf_dir: str, users: DataFrame | None = None, marked: DataFrame | None = None) -> DataFrame:
    """Purchases without the catalogue join; with ``users(user_id)`` theirs alone, chosen before lines are joined.

    With ``marked(user_id)``, each user once, a column ``mine`` tells their lines from the others.
    """
    line, order = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders")
    if users is not None:
        order = order.join(users.select(F.col("user_id").alias("o_custkey")), "o_custkey", "left_semi")
    if marked is not None:
        order = order.select("o_orderkey", "o_custkey", "o_orderdate").join(
            marked.select(F.col("user_id").alias("o_custkey"), F.lit(True).alias("mine")), "o_custkey", "left")
    returned = F.col("l_returnflag") == "R"
    day = F.to_date("o_orderdate")
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("o_orderdate").cast("timestamp").alias("purchase_ts"),
        F.col("l_linenumber").alias("seq"),
        F.col("o_orderkey").alias("order_id"),
        returned.alias("is_returned"),
        F.when(returned, F.date_add(day, 1 + F.col("l_linenumber") * 5).cast("timestamp")).alias("return_ts"),
        F.when(returned, 1 + F.col("l_linenumber") % 2).alias("regret_rating"),
        *([] if marked is None else [F.coalesce("mine", F.lit(False)).alias("mine")]),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_category(spark, sf_dir, purchase_lines(spark, sf_dir))


def with_category(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    category = raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.lower("p_type").alias("category")
    )
    return lines.join(category, "item_id")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "return").otherwise(F.col("event_type"))
    return (
        raw(spark, sf_dir, "events")
        .filter(F.col("event_type") != "signup")
        .select(
            "event_id",
            "user_id",
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("item_id"),
            kind.alias("event_type"),
            implicit_rating(kind).alias("rating"),
            F.col("value").alias("price"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("cat_"), F.col("label").cast("string")).alias("category"),
    )


def affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, category, n, affinity): share of the user's purchases per category."""
    return affinities_of(purchases(spark, sf_dir).withColumn("n", F.lit(1)))


def affinities_of(counted: DataFrame, rows: str | None = None) -> DataFrame:
    """The same from rows ``(user_id, category, n)`` that may repeat; ``rows`` names a column for their number."""
    more = [] if rows is None else [F.count("*").alias(rows)]
    per = counted.groupBy("user_id", "category").agg(F.sum("n").alias("n"), *more)
    # One row per user and category is left, so the per-user total is a small window, not a second join.
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return per.select("user_id", "category", "n", (F.col("n") / total).alias("affinity"), *([] if rows is None else [rows]))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_lines(spark, sf_dir).select("user_id", "item_id").distinct()


def daily_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        interactions(spark, sf_dir)
        .filter(F.col("event_type") != "return")
        .groupBy("item_id", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("units"), F.avg("price").alias("price"))
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        purchase_lines(spark, sf_dir)
        .select("seller_id", "user_id", "item_id", F.col("purchase_ts").alias("ts"))
        .join(items(spark, sf_dir).select("item_id", "rating"), "item_id")
        .join(users(spark, sf_dir).select("user_id", "ip_group"), "user_id")
    )
