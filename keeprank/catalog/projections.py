"""Scalar rules (2.2) run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.functions import arrays, context, hashing, scoring, text
from keeprank.operators import demand, elasticity, features, graph, ranking, regret
from keeprank.sources import tables as T

PAYDAY = [1, 15]
NOW = "2024-02-01 00:00:00"

# Category shifts over the categories that occur in the test tables.
SHIFTS = {
    "post_payday": {"economy": 0.1, "large": 0.3, "promo": 0.2},
    "late_night": {"small": 0.3, "promo": 0.4},
    "weekend_leisure": {"large": 0.2, "medium": 0.25},
    "emotional_comfort": {"small": 0.3, "economy": 0.3},
    "workday_lunch": {"small": 0.3, "standard": 0.2},
    "default": {"standard": 0.2, "economy": 0.15},
}
SHIFT_SQL = "(VALUES " + ", ".join(
    f"('{c}', '{k}', {v}::DOUBLE)" for c, per in SHIFTS.items() for k, v in per.items()
) + ") AS sh(context, category, delta)"

SCALAR_SQL = "(VALUES " + ", ".join(
    f"('{c}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for c, (a, b, d) in context.CONTEXT_SCALARS.items()
) + ") AS cs(context, price_tolerance, impulse, discovery)"


def engine_case(h: str, d: str, pay: str, comfort: str | None = None) -> str:
    extra = f"WHEN {comfort} > 0.5 THEN 'emotional_comfort'" if comfort else ""
    return (f"CASE WHEN {pay} THEN 'post_payday' {extra} WHEN {h} < 6 OR {h} >= 23 THEN 'late_night' "
            f"WHEN {d} >= 5 AND {h} >= 10 THEN 'weekend_leisure' "
            f"WHEN {d} < 5 AND {h} BETWEEN 7 AND 17 THEN 'workday_lunch' ELSE 'default' END")


def serving_case(h: str, d: str, pay: str) -> str:
    return (f"CASE WHEN {pay} THEN 'post_payday' WHEN {h} < 6 OR {h} >= 23 THEN 'late_night' "
            f"WHEN {d} >= 5 AND {h} BETWEEN 10 AND 20 THEN 'weekend_leisure' "
            f"WHEN {d} < 5 AND {h} BETWEEN 11 AND 13 THEN 'workday_lunch' ELSE 'default' END")


HOUR, DOW, PAY = "hour(ts)", "(isodow(ts) - 1)", "day(ts) IN (1, 15)"


def payday(ts):
    return F.dayofmonth(ts).isin(PAYDAY)


@query("implicit_rating", """
SELECT event_type, count(*) AS n, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 ELSE 0 END)::DOUBLE AS total
FROM events GROUP BY ALL""")
def implicit_rating(spark, d):
    return T.raw(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(context.implicit_rating(F.col("event_type"))).alias("total"))


@query("freshness_weight", """
SELECT user_id, count(*) AS n,
       round(sum(pow(2, -((epoch_us(TIMESTAMP '2024-02-01') // 1000000 - floor(epoch(ts))) / 86400.0::DOUBLE) / 14)), 6) AS weight
FROM interactions GROUP BY ALL""")
def freshness_weight(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return T.interactions(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum(scoring.freshness_weight(F.col("ts"), now)), 6).alias("weight"))


BUCKET_SQL = ("CASE WHEN price < 10 THEN '0-10' WHEN price < 50 THEN '10-50' WHEN price < 100 THEN '50-100' "
              "WHEN price < 500 THEN '100-500' ELSE '500+' END")


@query("price_bucket", f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM purchases GROUP BY ALL")
def price_bucket(spark, d):
    return T.purchase_lines(spark, d).groupBy(scoring.price_bucket(F.col("price")).alias("bucket")).agg(
        F.count("*").alias("n"))


@query("segment_key", f"SELECT concat(category, ':', {BUCKET_SQL}) AS segment, count(*) AS n FROM purchases GROUP BY ALL")
def segment_key(spark, d):
    return T.purchases(spark, d).groupBy(
        scoring.segment_key(F.col("category"), F.col("price")).alias("segment")).agg(F.count("*").alias("n"))


@query("emotional_context", f"SELECT {engine_case(HOUR, DOW, PAY)} AS context, count(*) AS n FROM interactions GROUP BY ALL")
def emotional_context(spark, d):
    ts = F.col("ts")
    return T.interactions(spark, d).groupBy(context.context_of(ts, payday(ts)).alias("context")).agg(
        F.count("*").alias("n"))


@query("emotional_context_serving",
       f"SELECT {serving_case(HOUR, DOW, PAY)} AS context, count(*) AS n FROM interactions GROUP BY ALL")
def emotional_context_serving(spark, d):
    ts = F.col("ts")
    return T.interactions(spark, d).groupBy(
        context.context_of(ts, payday(ts), "serving").alias("context")).agg(F.count("*").alias("n"))


@query("comfort_override", f"""
WITH s AS (SELECT user_id, sum(CASE WHEN category IN ('promo', 'small', 'economy') THEN n ELSE 0 END) / sum(n)::DOUBLE AS comfort
           FROM affinities GROUP BY 1)
SELECT user_id, {engine_case('12', '0', "user_id % 5 = 0", 'round(comfort, 9)')} AS context FROM s""")
def comfort_override(spark, d):
    signals = T.affinities(spark, d).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "affinity"))).alias("signals"))
    strength = F.round(context.comfort_strength(F.col("signals"), ["promo", "small", "economy"]), 9)
    return signals.select("user_id", context.emotional_context(
        F.lit(12), F.lit(0), F.col("user_id") % 5 == 0, strength).alias("context"))


@query("volatility_profile", f"""
WITH last AS (SELECT user_id, max(ts) AS ts FROM interactions GROUP BY 1),
r AS (SELECT u.user_id, coalesce(hour(ts), 12) AS h, coalesce(isodow(ts) - 1, 0) AS dow, coalesce(day(ts) IN (1, 15), false) AS pay,
             ts IS NOT NULL AS has_seq FROM users u LEFT JOIN last USING (user_id)),
c AS (SELECT *, {engine_case('h', 'dow', 'pay')} AS context FROM r)
SELECT user_id, context, concat(CASE WHEN dow < 5 THEN 'weekday' ELSE 'weekend' END, '_', CASE WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END) AS time_window,
       price_tolerance, impulse, discovery, CASE WHEN has_seq THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM c LEFT JOIN {SCALAR_SQL} USING (context)""")
def volatility_profile(spark, d):
    last = T.interactions(spark, d).groupBy("user_id").agg(F.max("ts").alias("ts"))
    requests = T.users(spark, d).select("user_id").join(last, "user_id", "left").select(
        "user_id", "ts", F.coalesce(F.hour("ts"), F.lit(12)).alias("hour"),
        F.coalesce(F.weekday("ts"), F.lit(0)).alias("weekday"),
        F.coalesce(payday(F.col("ts")), F.lit(False)).alias("is_payday"))
    return context.volatility_profile(requests, F.col("ts").isNotNull()).select(
        "user_id", "context", "time_window", "price_tolerance", "impulse", "discovery", "confidence")


@query("category_shift", f"""
WITH e AS (SELECT item_id, {serving_case(HOUR, DOW, PAY)} AS context FROM interactions)
SELECT e.context, i.category, count(*) AS n, any_value(coalesce(delta, 0)) AS delta
FROM e JOIN items i USING (item_id) LEFT JOIN {SHIFT_SQL} ON sh.context = e.context AND sh.category = i.category GROUP BY ALL""")
def category_shift(spark, d):
    ts = F.col("ts")
    events = T.interactions(spark, d).select("item_id", context.context_of(ts, payday(ts), "serving").alias("context"))
    counted = events.join(T.items(spark, d).select("item_id", "category"), "item_id").groupBy(
        "context", "category").agg(F.count("*").alias("n"))
    return counted.join(context.shift_table(spark, SHIFTS), ["context", "category"], "left").withColumn(
        "delta", F.coalesce("delta", F.lit(0.0)))


@query("context_overlap", f"""
WITH c AS (SELECT user_id, {engine_case(HOUR, DOW, PAY)} AS context, category, count(*) AS n
           FROM interactions JOIN items USING (item_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, context ORDER BY n DESC, category) AS rn FROM c),
s AS (SELECT user_id, context, list(category) AS cats FROM r WHERE rn <= 3 GROUP BY ALL)
SELECT a.user_id, a.context AS context_a, b.context AS context_b,
       round(len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))), 6) AS overlap
FROM s a JOIN s b ON a.user_id = b.user_id AND a.context < b.context""")
def context_overlap(spark, d):
    ts = F.col("ts")
    events = T.interactions(spark, d).select(
        "user_id", "item_id", context.context_of(ts, payday(ts)).alias("context"))
    seen = events.join(T.items(spark, d).select("item_id", "category"), "item_id")
    return features.context_overlap(seen, 3)


@query("sensitivity_class", """
WITH f AS (SELECT user_id, regr_slope(ln(quantity), ln(price)) AS elasticity FROM purchases GROUP BY 1)
SELECT CASE WHEN round(elasticity, 9) >= -0.5 THEN 'low' WHEN round(elasticity, 9) >= -2.0 THEN 'medium' ELSE 'high' END AS sensitivity, count(*) AS n
FROM f WHERE elasticity IS NOT NULL AND NOT isnan(elasticity) GROUP BY ALL""")
def sensitivity_class(spark, d):
    fitted = elasticity.elasticity_fit(T.purchase_lines(spark, d), ["user_id"])
    return fitted.filter("elasticity IS NOT NULL").groupBy(
        scoring.sensitivity_class(F.round("elasticity", 9)).alias("sensitivity")).agg(F.count("*").alias("n"))


@query("elasticity_score", """
WITH w AS (SELECT * FROM (VALUES ('high', 0.2::DOUBLE), ('medium', 0.5::DOUBLE), ('low', 0.8::DOUBLE)) AS t(sensitivity, w)),
s AS (SELECT h.user_id, u.price_sensitivity, w.w, i.price, i.rating
      FROM history h JOIN users u USING (user_id) JOIN items i USING (item_id) JOIN w ON w.sensitivity = u.price_sensitivity),
a AS (SELECT *, CASE WHEN price_sensitivity = 'high' THEN rating / greatest(price, 0.01) ELSE rating END AS v,
             CASE WHEN price_sensitivity = 'high' THEN rating ELSE rating * (1 + 0.1 * (5 - price)) END AS q FROM s)
SELECT user_id, round(sum((rating / 5) * (0.5 + 0.5 * ((1 - w) * v + w * q) / greatest(rating, 1))), 7) AS total FROM a GROUP BY 1""")
def elasticity_score(spark, d):
    u = T.users(spark, d).select("user_id", "price_sensitivity")
    pairs = T.history(spark, d).join(u, "user_id").join(T.items(spark, d).select("item_id", "price", "rating"), "item_id")
    sens = F.col("price_sensitivity")
    score = scoring.elasticity_score(F.col("rating") / 5, F.col("price"), F.col("rating"),
                                     elasticity.share_weight(sens), sens)
    return pairs.groupBy("user_id").agg(F.round(F.sum(score), 7).alias("total"))


@query("composite_score", """
SELECT item_id, round(0.55 * (rating / 5) + 0.20 * ((item_id % 30) / 30e0) + 0.10 * least(1, inventory / 100e0) + 0.15 * ((price - 5) / 200), 6) AS score
FROM items""")
def composite_score(spark, d):
    return T.items(spark, d).select("item_id", F.round(scoring.composite_score(
        F.col("rating") / 5, F.col("item_id") % 30 / F.lit(30.0),
        F.least(F.lit(1.0), F.col("inventory") / F.lit(100.0)), (F.col("price") - 5) / 200), 6).alias("score"))


PROFILE_SQL = f"""
SELECT concat(category, ':', {BUCKET_SQL}) AS segment, count(*) AS num_purchases, sum(is_returned::INT)::BIGINT AS num_returns,
       sum(is_returned::INT)::DOUBLE / count(*) AS return_rate, coalesce(avg(regret_rating), 0) AS avg_regret
FROM purchases GROUP BY ALL"""
PENALTY_SQL = ("CASE WHEN p.num_purchases >= 10 AND p.return_rate > 0.02 "
               "THEN greatest(0.1, 1 - (p.return_rate - 0.02) * 0.3) ELSE 1.0 END")


@query("regret_penalty", f"""
WITH p AS ({PROFILE_SQL}), i AS (SELECT item_id, concat(category, ':', {BUCKET_SQL}) AS segment FROM items)
SELECT i.item_id, round(({PENALTY_SQL})::DOUBLE, 6) AS penalty FROM i LEFT JOIN p USING (segment)""")
def regret_penalty(spark, d):
    profile = regret.regret_profile(T.purchases(spark, d))
    return regret.with_penalty(T.items(spark, d), profile).select("item_id", F.round("penalty", 6).alias("penalty"))


@query("return_outcome", """
SELECT category, count(*) AS n, count_if(return_ts IS NOT NULL)::BIGINT AS returned,
       round(avg((epoch(return_ts) - epoch(purchase_ts)) / 86400), 6) AS avg_days FROM purchases GROUP BY ALL""")
def return_outcome(spark, d):
    return regret.return_outcome(T.purchases(spark, d)).groupBy("category").agg(
        F.count("*").alias("n"), F.count_if("returned").alias("returned"),
        F.round(F.avg("days_to_return"), 6).alias("avg_days"))


@query("hour_bucket", "SELECT (floor(epoch(ts) / 3600)::BIGINT % 8760) AS bucket, count(*) AS n FROM interactions GROUP BY ALL")
def hour_bucket(spark, d):
    return T.interactions(spark, d).groupBy(scoring.hour_bucket(F.col("ts")).alias("bucket")).agg(
        F.count("*").alias("n"))


@query("bandit_context", """
SELECT user_id, sum(hour(ts))::DOUBLE AS hour_of_day, sum(isodow(ts) - 1)::DOUBLE AS day_of_week,
       sum((isodow(ts) >= 6)::INT)::DOUBLE AS is_weekend, 0::DOUBLE AS device_type FROM interactions GROUP BY ALL""")
def bandit_context(spark, d):
    vector = scoring.bandit_context(features.time_metadata(F.col("ts")))
    seen = T.interactions(spark, d).select("user_id", vector.alias("x"))
    return seen.groupBy("user_id").agg(*[
        F.sum(F.get("x", F.lit(i))).alias(name)
        for i, name in enumerate(S.BANDIT_FEATURES[:4])])


@query("hash_bucket", """
SELECT user_id, (concat('0x', substr(md5(concat(user_id::VARCHAR, ':users')), 1, 15))::BIGINT % 10000) AS bucket FROM users""")
def hash_bucket(spark, d):
    return T.users(spark, d).select("user_id", hashing.hash_bucket(F.col("user_id"), 10_000, "md5", "users").alias("bucket"))


@query("filter_edges", """
SELECT src, dst, edge_type, weight FROM edges WHERE dst = 'c:promo' AND edge_type = 'belongs_to'""")
def filter_edges(spark, d):
    return graph.filter_edges(graph.commerce_edges(spark, d), target="c:promo", types=["belongs_to"]).select(
        "src", "dst", "edge_type", "weight")


@query("nodes_by_type", "SELECT DISTINCT src AS node_id, 'seller' AS node_type FROM edges WHERE src LIKE 's:%'")
def nodes_by_type(spark, d):
    return graph.nodes_by_type(graph.nodes_of(graph.commerce_edges(spark, d)), "seller").select("node_id", "node_type")


@query("prune_old_edges", """
SELECT edge_type, count_if(ts >= TIMESTAMP '1999-01-01' OR ts IS NULL)::BIGINT AS kept,
       count_if(coalesce(ts < TIMESTAMP '1999-01-01', false))::BIGINT AS removed FROM edges GROUP BY ALL""")
def prune_old_edges(spark, d):
    return graph.prune_report(graph.commerce_edges(spark, d), F.lit("1999-01-01").cast("timestamp"))


@query("expire_ttl", """
SELECT user_id, count(*) AS live FROM interactions WHERE TIMESTAMP '2024-01-30 12:00:00' <= ts + INTERVAL 86400 SECOND GROUP BY ALL""")
def expire_ttl(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return T.interactions(spark, d).filter(scoring.is_live(F.col("ts"), now, S.TTL_SECONDS["user"])).groupBy(
        "user_id").agg(F.count("*").alias("live"))


@query("in_stock", "SELECT item_id, inventory FROM items WHERE inventory > 0")
def in_stock(spark, d):
    return T.items(spark, d).filter("inventory > 0").select("item_id", "inventory")


NAIVE_SQL = """
h AS (SELECT item_id, day, units, (isodow(day) - 1) AS dow FROM daily_units WHERE day < DATE '2024-01-24'),
m AS (SELECT item_id, dow, sum(units)::DOUBLE / CASE WHEN dow <= 1 THEN 4 ELSE 3 END AS mean_units
      FROM h GROUP BY item_id, dow),
f AS (SELECT k.item_id, s.h AS step, coalesce(m.mean_units, 0) AS units
      FROM (SELECT DISTINCT item_id FROM h) k CROSS JOIN (SELECT unnest(range(0, 30)) AS h) s
      LEFT JOIN m ON m.item_id = k.item_id AND m.dow = (isodow(DATE '2024-01-24') - 1 + s.h) % 7)"""


def naive_forecast(spark, d):
    return demand.seasonal_naive(T.daily_units(spark, d), "2024-01-01", "2024-01-24", S.FORECAST_DAYS)


@query("stockout_probability", f"""
WITH {NAIVE_SQL}
SELECT item_id, round(least(1, sum(units) FILTER (step < 7) / greatest(any_value(inventory), 1)), 9)::DOUBLE AS p7,
       round(least(1, sum(units) FILTER (step < 30) / greatest(any_value(inventory), 1)), 9)::DOUBLE AS p30
FROM f JOIN items USING (item_id) GROUP BY ALL""")
def stockout_probability(spark, d):
    joined = naive_forecast(spark, d).join(T.items(spark, d).select("item_id", "inventory"), "item_id")
    prob = lambda days: F.round(scoring.stockout_probability(F.col("forecast"), F.col("inventory"), days), 9)
    return joined.select("item_id", prob(7).alias("p7"), prob(30).alias("p30"))


@query("stock_status", f"""
WITH {NAIVE_SQL}, p AS (SELECT item_id, round(least(1, sum(units) FILTER (step < 7) / greatest(any_value(inventory % 60), 1)), 6) AS p FROM f JOIN items USING (item_id) GROUP BY ALL)
SELECT CASE WHEN p > 0.7 THEN 'LOW' WHEN p < 0.3 THEN 'OK' ELSE 'Medium' END AS status, count(*) AS n FROM p GROUP BY ALL""")
def stock_status(spark, d):
    joined = naive_forecast(spark, d).join(T.items(spark, d).select("item_id", "inventory"), "item_id")
    prob = F.round(scoring.stockout_probability(F.col("forecast"), F.col("inventory") % 60), 6)
    return joined.groupBy(scoring.stock_status(prob).alias("status")).agg(F.count("*").alias("n"))


@query("fraud_demotion", """
WITH c AS (SELECT user_id, item_id, count(*) AS n FROM purchases GROUP BY ALL),
s AS (SELECT c.user_id, c.item_id, round((c.n * i.rating) * CASE WHEN coalesce(r.probability, 0) >= 0.35 THEN 0.1 ELSE 1 END, 9) AS score
      FROM c JOIN items i USING (item_id) LEFT JOIN seller_risk r ON r.seller_id = i.seller_id)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s""")
def fraud_demotion(spark, d):
    counted = T.purchase_lines(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    risk = T.purchase_lines(spark, d).groupBy("seller_id").agg(
        (F.count_if("is_returned") / F.count("*")).alias("probability"))
    cand = counted.join(T.items(spark, d).select("item_id", "seller_id", "rating"), "item_id").join(risk, "seller_id", "left")
    score = scoring.fraud_demotion(F.col("n") * F.col("rating"), F.col("probability"), threshold=0.35)
    return ranking.rerank(cand, "user_id", score).select("user_id", "item_id", "score", "rank")


CENTROID_SQL = """
u AS (SELECT category, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM item_vectors),
m AS (SELECT category, p, avg(v) AS v FROM u GROUP BY ALL),
c AS (SELECT category, list(v ORDER BY p) AS centroid FROM m GROUP BY ALL)"""


@query("vector_similarity", f"""
WITH {CENTROID_SQL}
SELECT item_id, round(list_dot_product(embedding, centroid), 6) AS dot, round(list_cosine_similarity(embedding, centroid), 6) AS cosine,
       round(sqrt(list_dot_product(embedding, embedding)), 4) AS norm
FROM item_vectors JOIN c USING (category)""")
def vector_similarity(spark, d):
    vectors = T.item_vectors(spark, d)
    centroids = features.mean_vectors(vectors, "category").withColumnRenamed("mean_vector", "centroid")
    a, b = F.col("embedding"), F.col("centroid")
    return vectors.join(centroids, "category").select(
        "item_id", F.round(arrays.dot(a, b), 6).alias("dot"), F.round(arrays.cosine(a, b), 6).alias("cosine"),
        F.round(arrays.norm(a), 4).alias("norm"))


USER_VECTOR_SQL = """
x AS (SELECT i.user_id, unnest(v.embedding) AS v, generate_subscripts(v.embedding, 1) AS p
      FROM (SELECT DISTINCT user_id, item_id FROM interactions) i JOIN item_vectors v USING (item_id)),
um AS (SELECT user_id, p, avg(v) AS v FROM x GROUP BY ALL),
uv AS (SELECT user_id, list(v ORDER BY p) AS user_vector FROM um GROUP BY ALL)"""


def user_vectors(spark, d):
    return features.mean_of_items(T.interactions(spark, d), T.item_vectors(spark, d), "user_id").withColumnRenamed(
        "mean_vector", "user_vector")


@query("temperature_score", f"""
WITH {USER_VECTOR_SQL}
SELECT s.user_id, s.item_id, round(list_cosine_similarity(uv.user_vector, v.embedding) / 0.05, 5) AS score
FROM (SELECT DISTINCT user_id, item_id FROM interactions) s JOIN uv USING (user_id) JOIN item_vectors v USING (item_id)""")
def temperature_score(spark, d):
    seen = T.interactions(spark, d).select("user_id", "item_id").distinct()
    joined = seen.join(user_vectors(spark, d), "user_id").join(T.item_vectors(spark, d), "item_id")
    return joined.select("user_id", "item_id", F.round(arrays.temperature_score(
        F.col("user_vector"), F.col("embedding"), S.TEMPERATURE), 5).alias("score"))


@query("mood_score", f"""
WITH {USER_VECTOR_SQL}, {CENTROID_SQL}
SELECT s.user_id, s.item_id, round(list_dot_product(uv.user_vector, v.embedding) + list_dot_product(c.centroid, v.embedding), 6) AS score
FROM (SELECT DISTINCT user_id, item_id FROM interactions) s JOIN uv USING (user_id) JOIN item_vectors v USING (item_id) JOIN c USING (category)""")
def mood_score(spark, d):
    vectors = T.item_vectors(spark, d)
    bias = features.mean_vectors(vectors, "category").withColumnRenamed("mean_vector", "bias")
    seen = T.interactions(spark, d).select("user_id", "item_id").distinct()
    joined = seen.join(user_vectors(spark, d), "user_id").join(vectors, "item_id").join(bias, "category")
    return joined.select("user_id", "item_id", F.round(arrays.mood_score(
        F.col("user_vector"), F.col("embedding"), F.col("bias")), 6).alias("score"))


# Attribution features of one purchased pair: name -> SQL / Column over (n, affinity, price, rating).
ATTRIBUTION_SQL = """
p AS (SELECT user_id, item_id, category, count(*) AS n, min(price) AS paid FROM purchases GROUP BY ALL),
a AS (SELECT p.user_id, p.item_id, [
        {'name': 'category_match', 'value': f.affinity - 0.2}, {'name': 'popular_item', 'value': (i.rating - 3) / 20},
        {'name': 'price_fit', 'value': (60 - p.paid) / 400}, {'name': 'recent_purchase', 'value': (p.n - 1) * 0.3::DOUBLE},
        {'name': 'stock', 'value': (i.inventory - 500) / 5000e0}] AS feats
      FROM p JOIN affinities f ON f.user_id = p.user_id AND f.category = p.category JOIN items i ON i.item_id = p.item_id),
t AS (SELECT user_id, item_id, unnest(feats, recursive := true) FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(abs(value), 12) DESC, name) AS rn FROM t),
g AS (SELECT user_id, item_id, avg(value) AS base, least(1, max(abs(value))) AS confidence,
        list(CASE WHEN name LIKE '%view%' OR name LIKE '%seen%' THEN 'Based on items you recently viewed'
             WHEN name LIKE '%purchase%' OR name LIKE '%bought%' THEN 'Matches items you''ve previously purchased'
             WHEN name LIKE '%category%' OR name LIKE '%interest%' THEN 'Similar to categories you engage with'
             WHEN name LIKE '%popular%' OR name LIKE '%trending%' THEN 'Popular with shoppers like you'
             WHEN name LIKE '%price%' THEN 'Fits your usual price range'
             ELSE 'Recommended based on your preferences' END ORDER BY rn) FILTER (rn <= 3 AND value > 0) AS ph
      FROM r GROUP BY ALL)"""


@query("attribution_top3", f"""
WITH {ATTRIBUTION_SQL}
SELECT user_id, item_id, round(base, 9) AS base, round(confidence, 9)::DOUBLE AS confidence,
       CASE coalesce(len(ph), 0) WHEN 0 THEN 'Recommended for you' WHEN 1 THEN ph[1] WHEN 2 THEN concat(ph[1], ' and ', ph[2])
            ELSE concat(ph[1], ', ', ph[2], ', and ', ph[3]) END AS reason FROM g""")
def attribution_top3(spark, d):
    p = T.purchases(spark, d).groupBy("user_id", "item_id", "category").agg(
        F.count("*").alias("n"), F.min("price").alias("paid"))
    joined = p.join(T.affinities(spark, d).select("user_id", "category", "affinity"), ["user_id", "category"]).join(
        T.items(spark, d).select("item_id", "rating", "inventory"), "item_id")
    names = F.array(*map(F.lit, ["category_match", "popular_item", "price_fit", "recent_purchase", "stock"]))
    values = F.array(
        F.col("affinity") - 0.2, (F.col("rating") - 3) / 20, (F.lit(60) - F.col("paid")) / 400,
        (F.col("n") - 1) * F.lit(0.3), (F.col("inventory") - 500) / F.lit(5000.0))
    return joined.select(
        "user_id", "item_id", F.round(text.attribution_base(values), 9).alias("base"),
        F.round(text.attribution_confidence(values), 9).alias("confidence"),
        text.attribution_reason(names, values).alias("reason"))


@query("life_event_clusters", """
WITH c AS (SELECT * FROM (VALUES ('baby', 'small'), ('baby', 'economy'), ('new_home', 'large'), ('new_home', 'standard'), ('fitness', 'promo')) t(event_type, category))
SELECT event_type, category, count(*) AS n FROM c JOIN purchases USING (category) GROUP BY ALL""")
def life_event_clusters(spark, d):
    from keeprank.operators import lifestage

    clusters = lifestage.cluster_table(spark, DRIVER_CLUSTERS)
    counted = T.purchases(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return clusters.join(counted, "category").select("event_type", "category", "n")


DRIVER_CLUSTERS = {"baby": ["small", "economy"], "new_home": ["large", "standard"], "fitness": ["promo"]}
