"""Aggregations (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.catalog.projections import BUCKET_SQL, PROFILE_SQL, USER_VECTOR_SQL, user_vectors
from keeprank.functions import scoring
from keeprank.operators import bandit, elasticity, factors, features, fraud, graph, metrics, ranking, regret, timeseries
from keeprank.operators import discovery as disc
from keeprank.sources import tables as T

NOW = "2024-02-01 00:00:00"


def r6(name: str):
    return F.round(name, 6).alias(name)


@query("regret_profile", f"""
WITH p AS ({PROFILE_SQL}) SELECT segment, num_purchases, num_returns, round(return_rate, 6) AS return_rate, round(avg_regret, 6) AS avg_regret FROM p""")
def regret_profile(spark, d):
    return regret.regret_profile(T.purchases(spark, d)).select(
        "segment", "num_purchases", "num_returns", r6("return_rate"), r6("avg_regret"))


@query("regret_classes", """
WITH c AS (SELECT category, sum(is_returned::INT)::DOUBLE / count(*) AS return_rate FROM purchases GROUP BY 1)
SELECT category, round(return_rate, 6) AS return_rate, CASE WHEN return_rate > 0.33 * 1.015 THEN 'high' WHEN return_rate < 0.33 * 0.5 THEN 'low' ELSE 'neutral' END AS regret FROM c""")
def regret_classes(spark, d):
    return regret.regret_classes(T.purchases(spark, d), threshold=0.33 * 1.015 / 1.5).select(
        "category", r6("return_rate"), "regret")


@query("regret_summary", f"""
WITH p AS ({PROFILE_SQL}) SELECT segment, num_purchases, round(return_rate, 6) AS return_rate, return_rate > 0.33 AS needs_attention FROM p""")
def regret_summary(spark, d):
    return regret.regret_summary(regret.regret_profile(T.purchases(spark, d)), 0.33).select(
        "segment", "num_purchases", r6("return_rate"), "needs_attention")


@query("regret_rollup", f"""
SELECT coalesce(user_segment, '*') AS user_segment, coalesce(category, '*') AS category, coalesce(price_range, '*') AS price_range,
       grouping(user_segment, category, price_range)::BIGINT AS level,
       count(*) AS num_purchases, sum(is_returned::INT)::BIGINT AS num_returns, round(sum(is_returned::INT)::DOUBLE / count(*), 6) AS return_rate
FROM (SELECT u.user_segment, p.category, {BUCKET_SQL} AS price_range, is_returned FROM purchases p JOIN users u USING (user_id))
GROUP BY ROLLUP (user_segment, category, price_range)""")
def regret_rollup(spark, d):
    joined = T.purchases(spark, d).join(T.users(spark, d).select("user_id", "user_segment"), "user_id")
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return regret.regret_rollup(joined).select(
        star("user_segment"), star("category"), star("price_range"), "level", "num_purchases", "num_returns", r6("return_rate"))


@query("overall_return_rate", """
SELECT count(*) AS num_purchases, sum(is_returned::INT)::BIGINT AS num_returns, round(sum(is_returned::INT)::DOUBLE / count(*), 6) AS return_rate FROM purchases""")
def overall_return_rate(spark, d):
    return regret.overall_return_rate(T.purchase_lines(spark, d)).select("num_purchases", "num_returns", r6("return_rate"))


@query("ctr", """
SELECT item_id, count_if(event_type = 'view')::BIGINT AS impressions, count_if(event_type = 'click')::BIGINT AS clicks,
       round(count_if(event_type = 'click') / greatest(count_if(event_type = 'view'), 1)::DOUBLE, 6) AS ctr FROM interactions GROUP BY 1""")
def ctr(spark, d):
    kind = F.col("event_type")
    return metrics.ctr(T.interactions(spark, d), ["item_id"], kind == "view", kind == "click").withColumn("ctr", F.round("ctr", 6))


ARM_SQL = "CASE concat('0x', substr(md5(concat(user_id, ':7')), 1, 15))::BIGINT % 2 WHEN 0 THEN 'control' ELSE 'treatment' END"


@query("ctr_lift", f"""
WITH a AS (SELECT day(ts) AS day, {ARM_SQL} AS arm, event_type FROM interactions),
c AS (SELECT day, arm, count_if(event_type = 'click') / greatest(count_if(event_type = 'view'), 1)::DOUBLE AS ctr FROM a GROUP BY ALL),
p AS (SELECT day, coalesce(max(ctr) FILTER (arm = 'control'), 0) AS control, coalesce(max(ctr) FILTER (arm = 'treatment'), 0) AS treatment FROM c GROUP BY 1)
SELECT day, round(CASE WHEN control = 0 THEN 0 ELSE (treatment - control) / control END, 6) AS lift FROM p""")
def ctr_lift(spark, d):
    arm = metrics.experiment_arm(F.col("user_id"), ["control", "treatment"])
    log = T.interactions(spark, d).select(F.dayofmonth("ts").cast("bigint").alias("day"), arm.alias("arm"), "event_type")
    kind = F.col("event_type")
    rates = metrics.ctr(log, ["day", "arm"], kind == "view", kind == "click")
    wide = rates.groupBy("day").pivot("arm", ["control", "treatment"]).agg(F.max("ctr")).fillna(0.0)
    return wide.select("day", F.round(metrics.lift(F.col("treatment"), F.col("control")), 6).alias("lift"))


@query("return_rate", """
SELECT item_id, count(*) AS purchased, sum(is_returned::INT)::BIGINT AS returned, round(sum(is_returned::INT)::DOUBLE / count(*), 6) AS return_rate FROM purchases GROUP BY 1""")
def return_rate(spark, d):
    return metrics.return_rate(T.purchase_lines(spark, d), ["item_id"]).withColumn("return_rate", F.round("return_rate", 6))


DISCOVERY_SQL = """
rc AS (SELECT i.user_id, t.category FROM interactions i JOIN items t USING (item_id)),
kn AS (SELECT DISTINCT user_id, category FROM purchases WHERE is_returned AND price > 40),
ds AS (SELECT rc.user_id, avg((kn.category IS NULL)::INT) AS discovery_score FROM rc LEFT JOIN kn ON kn.user_id = rc.user_id AND kn.category = rc.category GROUP BY 1)"""


def _discovery(spark, d):
    recs = T.interactions(spark, d).select("user_id", "item_id").join(T.items(spark, d).select("item_id", "category"), "item_id")
    return metrics.discovery_score(recs, T.purchases(spark, d).filter("is_returned AND price > 40"))


@query("discovery_score", f"WITH {DISCOVERY_SQL} SELECT user_id, round(discovery_score, 6) AS discovery_score FROM ds")
def discovery_score(spark, d):
    return _discovery(spark, d).select("user_id", r6("discovery_score"))


@query("needs_discovery", f"WITH {DISCOVERY_SQL} SELECT user_id, round(discovery_score, 6) AS discovery_score FROM ds WHERE discovery_score < 0.15")
def needs_discovery(spark, d):
    return disc.needs_discovery(_discovery(spark, d)).select("user_id", r6("discovery_score"))


PREDICTED_SQL = """
pr AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank
       FROM (SELECT user_id, item_id, count(*) AS n FROM interactions WHERE event_type IN ('view', 'click') GROUP BY ALL)),
ac AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE event_type = 'purchase')"""


def predicted_and_actual(spark, d):
    log = T.interactions(spark, d)
    counted = log.filter("event_type IN ('view', 'click')").groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    predicted = ranking.ranked(counted, ["user_id"], [F.desc("n"), F.asc("item_id")])
    return predicted, log.filter("event_type = 'purchase'").select("user_id", "item_id").distinct()


@query("precision_recall_at_k", f"""
WITH {PREDICTED_SQL},
l AS (SELECT user_id, count(*) AS listed FROM pr WHERE rank <= 10 GROUP BY 1), n AS (SELECT user_id, count(*) AS relevant FROM ac GROUP BY 1),
h AS (SELECT user_id, count(*) AS hits FROM (SELECT user_id, item_id FROM pr WHERE rank <= 10) JOIN ac USING (user_id, item_id) GROUP BY 1)
SELECT user_id, coalesce(hits, 0) AS hits, round(CASE WHEN coalesce(listed, 0) = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / listed END, 6) AS precision,
       round(coalesce(hits, 0)::DOUBLE / greatest(coalesce(relevant, 0), 1), 6) AS recall
FROM l FULL JOIN n USING (user_id) LEFT JOIN h USING (user_id)""")
def precision_recall_at_k(spark, d):
    return metrics.precision_recall(*predicted_and_actual(spark, d), 10).select("user_id", "hits", r6("precision"), r6("recall"))


@query("ndcg_at_k", """
WITH s AS (SELECT user_id, item_id, count_if(event_type <> 'purchase') AS n, least(3, count_if(event_type = 'purchase')) AS rel FROM interactions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, rank) AS best FROM r),
g AS (SELECT user_id, sum(CASE WHEN rank <= 50 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
             sum(CASE WHEN best <= 50 THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS idcg FROM b GROUP BY 1)
SELECT user_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM g""")
def ndcg_at_k(spark, d):
    bought = F.count_if(F.col("event_type") == "purchase")
    scored = T.interactions(spark, d).groupBy("user_id", "item_id").agg(
        (F.count("*") - bought).alias("n"), F.least(F.lit(3), bought).alias("relevance"))
    ranked = ranking.ranked(scored, ["user_id"], [F.desc("n"), F.asc("item_id")])
    return metrics.ndcg(ranked, 50).select("user_id", r6("ndcg"))


@query("fraud_ring_recall", """
WITH f AS (SELECT DISTINCT seller_id FROM reviews WHERE rating >= 4.9 AND ip_group < 3),
a AS (SELECT DISTINCT seller_id FROM reviews WHERE rating <= 1.1 AND ip_group < 3)
SELECT count(*) AS actual, count(f.seller_id)::BIGINT AS found, round(CASE WHEN count(*) = 0 THEN 1 ELSE count(f.seller_id)::DOUBLE / count(*) END, 6) AS recall
FROM a LEFT JOIN f USING (seller_id)""")
def fraud_ring_recall(spark, d):
    rings = lambda cond: T.reviews(spark, d).filter(cond).groupBy("ip_group").agg(F.collect_set("seller_id").alias("members"))
    return metrics.fraud_ring_recall(rings("rating >= 4.9 AND ip_group < 3"), rings("rating <= 1.1 AND ip_group < 3")).select(
        "actual", "found", r6("recall"))


POPULARITY_SQL = "(0.4 * rating + 0.3 * ln(1 + review_count)) * (0.5 + 0.5 * least(1, inventory / 100e0))"


@query("popularity", f"""
SELECT * FROM (SELECT item_id, round({POPULARITY_SQL}, 6) AS popularity, row_number() OVER (ORDER BY round({POPULARITY_SQL}, 9) DESC, item_id) AS rank
FROM items_with_reviews) WHERE rank <= 200""")
def popularity(spark, d):
    scored = T.items_with_reviews(spark, d).select("item_id", F.round(scoring.popularity(
        F.col("rating"), F.col("review_count"), F.col("inventory")), 9).alias("popularity"))
    return metrics.popularity_rank(scored, 200).select("item_id", r6("popularity"), "rank")


MATRIX_SQL = """
mx AS (SELECT user_id, item_id, sum(rating * pow(2, -((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) / 14)) AS value FROM interactions GROUP BY ALL)"""


def matrix(spark, d):
    return factors.interaction_matrix(T.interactions(spark, d), F.lit(NOW).cast("timestamp"))


@query("interaction_matrix", f"WITH {MATRIX_SQL} SELECT user_id, item_id, round(value, 6) AS value FROM mx")
def interaction_matrix(spark, d):
    return matrix(spark, d).select("user_id", "item_id", r6("value"))


@query("matrix_bias", f"""
WITH {MATRIX_SQL}
SELECT 'user' AS kind, user_id AS id, round(sum(value) / (SELECT count(DISTINCT item_id) FROM mx) - (SELECT avg(value) FROM mx), 6) AS bias FROM mx GROUP BY ALL
UNION ALL SELECT 'item', item_id, round(sum(value) / (SELECT count(DISTINCT user_id) FROM mx) - (SELECT avg(value) FROM mx), 6) FROM mx GROUP BY ALL""")
def matrix_bias(spark, d):
    return factors.matrix_bias(matrix(spark, d)).select("kind", "id", r6("bias"))


@query("degree", """
SELECT node, count(DISTINCT nbr) AS degree FROM (SELECT src AS node, dst AS nbr FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY 1""")
def degree(spark, d):
    return graph.degree(graph.commerce_edges(spark, d))


@query("graph_counts", """
WITH n AS (SELECT DISTINCT src AS id FROM edges UNION SELECT DISTINCT dst FROM edges),
c AS (SELECT 'node' AS what, CASE id[1] WHEN 'u' THEN 'user' WHEN 'p' THEN 'product' WHEN 's' THEN 'seller' ELSE 'category' END AS kind, count(*) AS n FROM n GROUP BY ALL
      UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL)
SELECT what, kind, n FROM c UNION ALL SELECT what, 'all', sum(n)::BIGINT FROM c GROUP BY 1""")
def graph_counts(spark, d):
    return graph.graph_counts(graph.commerce_edges(spark, d))


@query("bucket_agg", """
SELECT floor(epoch(ts) / 3600)::BIGINT AS bucket, sum(floor(price * 1000)::BIGINT)::BIGINT AS total, arg_max(price, event_id) AS last_value FROM interactions GROUP BY 1""")
def bucket_agg(spark, d):
    log = T.interactions(spark, d).withColumn("bucket", timeseries.hour_of_epoch(F.col("ts")))
    added = timeseries.bucket_agg(log, ["bucket"], "price", "add", scale=1000).withColumnRenamed("value", "total")
    last = timeseries.bucket_agg(log, ["bucket"], "price", "set", seq="event_id").withColumnRenamed("value", "last_value")
    return added.join(last, "bucket")


@query("range_agg", """
WITH b AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS bucket, price FROM interactions),
r AS (SELECT DISTINCT user_id AS range_id, 473352 + (user_id * 13) % 700 AS lo, 473352 + (user_id * 13) % 700 + (user_id * 7) % 120 AS hi FROM interactions)
SELECT r.range_id, round(coalesce(sum(price), 0), 4) AS total, coalesce(min(price), 0) AS lowest, coalesce(max(price), 0) AS highest, count(b.price)::DOUBLE AS n
FROM r LEFT JOIN b ON b.bucket >= r.lo AND b.bucket < r.hi GROUP BY 1""")
def range_agg(spark, d):
    log = T.interactions(spark, d)
    buckets = log.select(timeseries.hour_of_epoch(F.col("ts")).alias("bucket"), F.col("price").alias("value"))
    lo = F.lit(473352) + F.col("user_id") * 13 % 700
    ranges = log.select(F.col("user_id").alias("range_id"), lo.alias("lo"), (lo + F.col("user_id") * 7 % 120).alias("hi")).distinct()
    return timeseries.range_agg(buckets, ranges, {
        "total": (F.sum, F.sum), "lowest": (F.min, F.min), "highest": (F.max, F.max),
        "n": (lambda c: F.count(c).cast("double"), F.sum)}).withColumn("total", F.round("total", 4))


@query("window_total", """
SELECT user_id, round(sum(price), 4) AS total FROM interactions WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def window_total(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return timeseries.window_total(T.interactions(spark, d), ["user_id"], "price", at("2024-01-10"), at("2024-01-20")).select(
        "user_id", F.round("total", 4).alias("total"))


PULLS_SQL = """
pl AS (SELECT i.category AS arm_id, [hour(ts)::DOUBLE, (isodow(ts) - 1)::DOUBLE, (isodow(ts) >= 6)::INT::DOUBLE, 0, 0, 0] AS x, e.rating AS reward
       FROM interactions e JOIN items i USING (item_id))"""


def pulls(spark, d):
    log = T.interactions(spark, d).select(
        "user_id", "item_id", "event_id", scoring.bandit_context(features.time_metadata(F.col("ts"))).alias("x"), F.col("rating").alias("reward"))
    return log.join(T.items(spark, d).select("item_id", F.col("category").alias("arm_id")), "item_id")


@query("arm_stats", f"""
WITH {PULLS_SQL} SELECT arm_id, count(*) AS pulls, sum(reward) AS total_reward, round(sum(reward) / count(*), 6) AS avg_reward, count(*) >= 50 AS is_warm FROM pl GROUP BY 1""")
def arm_stats(spark, d):
    return metrics.arm_stats(pulls(spark, d), S.BANDIT_WARM).withColumn("avg_reward", F.round("avg_reward", 6))


@query("linucb_fit", f"""
WITH {PULLS_SQL}, ij AS (SELECT i, j FROM (SELECT unnest(range(0, 6)) AS i) a, (SELECT unnest(range(0, 6)) AS j) b)
SELECT arm_id, 'A' AS part, i * 6 + j AS pos, sum(x[i + 1] * x[j + 1]) + (i = j)::INT AS value FROM pl, ij GROUP BY arm_id, i, j
UNION ALL SELECT arm_id, 'b', i, sum(x[i + 1] * reward) FROM pl, (SELECT unnest(range(0, 6)) AS i) a GROUP BY arm_id, i""")
def linucb_fit(spark, d):
    stats = bandit.linucb_fit(pulls(spark, d))
    part = lambda name: stats.select("arm_id", F.lit(name).alias("part"), F.posexplode(name).alias("pos", "value"))
    return part("A").unionByName(part("b")).withColumn("pos", F.col("pos").cast("bigint"))


@query("user_history", "SELECT DISTINCT user_id, category FROM interactions JOIN items USING (item_id)")
def user_history(spark, d):
    seen = T.interactions(spark, d).select("user_id", "item_id").join(T.items(spark, d).select("item_id", "category"), "item_id")
    return features.user_history(seen)


@query("category_affinity", """
WITH a AS (SELECT user_id, category, count(*)::DOUBLE AS n FROM purchases GROUP BY ALL),
b AS (SELECT user_id, category, count(*)::DOUBLE AS n FROM interactions JOIN items USING (item_id) GROUP BY ALL)
SELECT user_id, category, coalesce(a.n, 0) + coalesce(b.n, 0) AS affinity FROM a FULL JOIN b USING (user_id, category)""")
def category_affinity(spark, d):
    def as_map(seen, name):
        return features.category_affinity(seen).groupBy("user_id").agg(
            F.map_from_entries(F.collect_list(F.struct("category", "affinity"))).alias(name))

    old = as_map(T.purchases(spark, d), "old")
    new = as_map(T.interactions(spark, d).select("user_id", "item_id").join(
        T.items(spark, d).select("item_id", "category"), "item_id"), "new")
    none = F.create_map().cast("map<string,double>")
    merged = features.merge_affinity_maps(F.coalesce("old", none), F.coalesce("new", none))
    return old.join(new, "user_id", "full").select("user_id", F.explode(merged).alias("category", "affinity"))


@query("latency_stats", """
WITH t AS (SELECT event_type AS step, value AS ms FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ms) - 1 AS idx, count(*) OVER (PARTITION BY step) AS n FROM t)
SELECT step, any_value(n) AS n, round(avg(ms), 6) AS mean, max(ms) FILTER (idx = (n * 99) // 100) AS p99 FROM r GROUP BY 1""")
def latency_stats(spark, d):
    timings = T.raw(spark, d, "events").select(F.col("event_type").alias("step"), F.col("value").alias("ms"))
    return metrics.latency_stats(timings).withColumn("mean", F.round("mean", 6))


@query("seller_indicators", """
WITH s AS (SELECT seller_id, isodow(ts) AS slot, count(*) AS n FROM reviews GROUP BY ALL),
t AS (SELECT seller_id, count(*) AS reviews, count(DISTINCT ip_group) AS prefixes, avg(rating) AS avg_rating,
             (avg(pow(rating, 3)) - 3 * avg(rating) * avg(rating * rating) + 2 * pow(avg(rating), 3)) / pow(var_pop(rating), 1.5) AS skew FROM reviews GROUP BY 1),
e AS (SELECT s.seller_id, sum(-(n / reviews::DOUBLE) * ln(n / reviews::DOUBLE)) AS h FROM s JOIN t USING (seller_id) GROUP BY 1),
a AS (SELECT seller_id, max(c) / sum(c)::DOUBLE AS burst FROM (SELECT seller_id, user_id, count(*) AS c FROM reviews GROUP BY ALL) GROUP BY 1)
SELECT seller_id, reviews, prefixes, round(prefixes::DOUBLE / reviews, 6) AS ip_diversity, round(skew, 5) AS rating_skew, round(h, 6) AS timing_entropy, round(burst, 6) AS burstiness
FROM t JOIN e USING (seller_id) JOIN a USING (seller_id)""")
def seller_indicators(spark, d):
    return fraud.seller_indicators(T.reviews(spark, d)).select(
        "seller_id", "reviews", "prefixes", r6("ip_diversity"), F.round("rating_skew", 5).alias("rating_skew"),
        r6("timing_entropy"), r6("burstiness"))


@query("elasticity_features", """
WITH o AS (SELECT user_id, order_id, sum(price) AS v FROM purchases GROUP BY ALL), a AS (SELECT user_id, avg(v) AS aov, count(*) AS orders FROM o GROUP BY 1)
SELECT p.user_id, count(*) AS purchases, any_value(a.orders) AS orders, round(any_value(a.aov), 10) AS avg_order_value, round(avg((discount > 0)::INT), 6) AS discount_rate,
       round(quantile_cont(price, 0.1), 8) AS price_p10, round(quantile_cont(price, 0.9), 8) AS price_p90, round(max(price) FILTER (NOT is_returned), 8) AS willingness_to_pay
FROM purchases p JOIN a USING (user_id) GROUP BY 1""")
def elasticity_features(spark, d):
    r8 = lambda c: F.round(c, 8).alias(c)
    return elasticity.elasticity_features(T.purchase_lines(spark, d)).select(
        "user_id", "purchases", "orders", F.round("avg_order_value", 10).alias("avg_order_value"), r6("discount_rate"), r8("price_p10"), r8("price_p90"), r8("willingness_to_pay"))


@query("preference_vector", f"""
WITH {USER_VECTOR_SQL} SELECT user_id, p - 1 AS pos, round(v, 6) AS value FROM um""")
def preference_vector(spark, d):
    return user_vectors(spark, d).select("user_id", F.posexplode("user_vector").alias("pos", "value")).select(
        "user_id", F.col("pos").cast("bigint").alias("pos"), r6("value"))


@query("ab_report", f"""
WITH a AS (SELECT e.user_id, e.event_type, {ARM_SQL} AS arm, i.category FROM interactions e JOIN items i USING (item_id)),
k AS (SELECT DISTINCT user_id, category FROM purchases WHERE is_returned AND price > 40)
SELECT arm, count_if(event_type = 'view')::BIGINT AS impressions, round(count_if(event_type = 'click') / greatest(count_if(event_type = 'view'), 1)::DOUBLE, 6) AS ctr,
       round(count_if(event_type = 'purchase') / greatest(count_if(event_type = 'click'), 1)::DOUBLE, 6) AS conversion,
       round(count_if(event_type = 'return') / greatest(count_if(event_type = 'purchase'), 1)::DOUBLE, 6) AS return_rate,
       round(avg((k.category IS NULL)::INT), 6) AS discovery, count_if({ARM_SQL.replace("':7'", "':11'").replace('% 2 WHEN 0', '% 10000 < 500 WHEN true').replace("'control'", "1").replace("'treatment'", "0").replace('user_id', 'a.user_id')} = 1)::BIGINT AS shadow_rows
FROM a LEFT JOIN k ON k.user_id = a.user_id AND k.category = a.category GROUP BY 1""")
def ab_report(spark, d):
    from keeprank.plans.reports import ab_report as report

    log = T.interactions(spark, d).join(T.items(spark, d).select("item_id", "category"), "item_id")
    out = report(log, T.purchases(spark, d).filter("is_returned AND price > 40"))
    return out.select("arm", "impressions", r6("ctr"), r6("conversion"), r6("return_rate"), r6("discovery"), "shadow_rows")
