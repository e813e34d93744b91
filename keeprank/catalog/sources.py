"""Reading, appending, upserting and removing (2.1, batch side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.functions.scoring import expires_at
from keeprank.operators import features, graph, sampling
from keeprank.schemas import RAW
from keeprank.session import scratch_path
from keeprank.sources import interactions as I
from keeprank.sources import tables as T


@query("load_interactions", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""")
def load_interactions(spark, d):
    log = I.load_interactions(spark, f"{d}/events.parquet", schema=RAW["events"], since="2024-01-10")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("ingest_events", """
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase', 'add_to_cart', 'return') THEN 'accepted' ELSE 'event_type not allowed' END AS outcome,
       count(*) AS n FROM events GROUP BY ALL""")
def ingest_events(spark, d):
    events = T.raw(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    good, bad = scratch_path(spark, "events"), scratch_path(spark, "rejects")
    I.ingest_events(events, good, bad)
    accepted = spark.read.parquet(good).select(F.lit("accepted").alias("outcome"))
    return accepted.unionByName(spark.read.parquet(bad).select(F.col("reject_reason").alias("outcome"))).groupBy(
        "outcome").agg(F.count("*").alias("n"))


@query("build_edges", """
SELECT src, edge_type, count(*) AS edges, sum(weight) AS weight, max(epoch_us(ts) // 1000000) AS last_ts FROM edges GROUP BY ALL""")
def build_edges(spark, d):
    return graph.commerce_edges(spark, d).groupBy("src", "edge_type").agg(
        F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.unix_seconds(F.max("ts")).alias("last_ts"))


@query("upsert_nodes", """
WITH o AS (SELECT src AS node_id, epoch_us(ts) // 1000000 AS t, weight, edge_type FROM edges WHERE ts IS NOT NULL
           UNION ALL SELECT dst, epoch_us(ts) // 1000000, weight, edge_type FROM edges WHERE ts IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t DESC, edge_type DESC, weight DESC) AS rn,
             min(t) OVER (PARTITION BY node_id) AS created_at, max(t) OVER (PARTITION BY node_id) AS updated_at FROM o)
SELECT node_id, created_at, updated_at, edge_type, weight FROM r WHERE rn = 1""")
def upsert_nodes(spark, d):
    edges = graph.commerce_edges(spark, d).filter("ts IS NOT NULL").withColumn("ts", F.unix_seconds("ts"))
    seen = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "ts", "edge_type", "weight")
    return graph.upsert_nodes(seen)


@query("remove_node", """
WITH gone AS (SELECT concat('p:', item_id) AS node_id FROM items WHERE inventory < 300)
SELECT edge_type, count(*) AS edges, sum(weight) AS weight FROM edges
WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone) GROUP BY ALL""")
def remove_node(spark, d):
    gone = T.items(spark, d).filter("inventory < 300").select(
        F.concat(F.lit("p:"), F.col("item_id").cast("string")).alias("node_id"))
    return graph.remove_nodes(graph.commerce_edges(spark, d), gone).groupBy("edge_type").agg(
        F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query("remove_items", """
SELECT item_id, category FROM item_vectors WHERE item_id NOT IN (SELECT item_id FROM interactions WHERE event_type = 'return')""")
def remove_items(spark, d):
    returned = T.interactions(spark, d).filter("event_type = 'return'").select("item_id")
    return I.drop_stale(T.item_vectors(spark, d).select("item_id", "category"), returned, "item_id")


@query("feature_upsert", """
WITH u AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS ts, event_id, price,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM interactions)
SELECT user_id, event_type, price, ts, ts + 86400 AS expires_at FROM u WHERE rn = 1""")
def feature_upsert(spark, d):
    updates = T.interactions(spark, d).select(
        "user_id", "event_type", "price", "ts", F.col("event_id").alias("version"))
    ttl = F.make_dt_interval(secs=F.lit(S.TTL_SECONDS["user"]))
    return features.latest_features(updates, ["user_id", "event_type"], ttl).select(
        "user_id", "event_type", "price", F.unix_seconds("ts").alias("ts"),
        F.unix_seconds("expires_at").alias("expires_at"))


@query("stale_keys", """
WITH t AS (SELECT DISTINCT concat('user:', user_id, ':', event_type) AS key FROM interactions)
SELECT key FROM t WHERE key NOT LIKE 'user:1%:view'""")
def stale_keys(spark, d):
    keys = T.interactions(spark, d).select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("key")).distinct()
    return I.drop_matching(keys, "user:1*:view")


@query("save_training_data", """
SELECT event_type, count(*) AS n, sum(rating) AS rating FROM interactions GROUP BY ALL""")
def save_training_data(spark, d):
    path = scratch_path(spark, "training")
    I.save_training_data(T.interactions(spark, d).select("user_id", "item_id", "rating", "event_type"), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("rating").alias("rating"))


@query("materialise_recs", """
WITH c AS (SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM c)
SELECT 'homepage' AS surface, user_id, item_id, rank, epoch_us(TIMESTAMP '2024-02-01' + INTERVAL 60 SECOND) // 1000000 AS expires_at FROM r WHERE rank <= 50""")
def materialise_recs(spark, d):
    from keeprank.operators.ranking import top_k

    counted = T.interactions(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    recs = top_k(counted, ["user_id"], [F.desc("n"), F.asc("item_id")], S.DEFAULT_TOP_K).withColumn(
        "surface", F.lit("homepage"))
    path = scratch_path(spark, "recs")
    I.materialise_recs(recs, path, F.lit("2024-02-01").cast("timestamp"), S.TTL_SECONDS["recs"])
    return spark.read.parquet(path).select(
        "surface", "user_id", "item_id", "rank", F.unix_seconds("expires_at").alias("expires_at"))


@query("distinct_entities", """
SELECT 'user' AS kind, count(DISTINCT user_id) AS n FROM interactions UNION ALL SELECT 'item', count(DISTINCT item_id) FROM interactions""")
def distinct_entities(spark, d):
    log = T.interactions(spark, d)
    users = log.select("user_id").distinct().agg(F.count("*").alias("n")).select(F.lit("user").alias("kind"), "n")
    items = log.select("item_id").distinct().agg(F.count("*").alias("n")).select(F.lit("item").alias("kind"), "n")
    return users.unionByName(items)


@query("training_union", """
WITH p AS (SELECT user_id, item_id, rating, ts FROM interactions WHERE rating > 0),
n AS (SELECT DISTINCT user_id, (item_id + 7) % 100 AS item_id FROM interactions WHERE event_type = 'return')
SELECT coalesce(category, '?') AS category, count(*) AS n, count(ts)::BIGINT AS timed, sum(x.rating) AS rating
FROM (SELECT * FROM p UNION ALL SELECT user_id, item_id, 0::DOUBLE, NULL FROM n) x LEFT JOIN items USING (item_id) GROUP BY ALL""")
def training_union(spark, d):
    log = T.interactions(spark, d)
    negatives = log.filter("event_type = 'return'").select("user_id", ((F.col("item_id") + 7) % 100).alias("item_id")).distinct()
    rows = sampling.training_union(log.filter("rating > 0"), negatives, T.items(spark, d))
    return rows.groupBy(F.coalesce("category", F.lit("?")).alias("category")).agg(
        F.count("*").alias("n"), F.count("ts").alias("timed"), F.sum("rating").alias("rating"))
