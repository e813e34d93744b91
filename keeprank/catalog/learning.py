"""Models, forecasts, life-stage vectors and bandit rankings (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.catalog.aggregates import MATRIX_SQL, matrix, pulls
from keeprank.catalog.joins import md5
from keeprank.catalog.projections import CENTROID_SQL, NAIVE_SQL, USER_VECTOR_SQL, engine_case, naive_forecast, user_vectors
from keeprank.catalog.windows import LIFE_SQL, detected_events
from keeprank.functions import context, scoring
from keeprank.operators import bandit, demand, elasticity, factors, features, fraud, learned, lifestage, ranking, sampling, towers
from keeprank.operators import similarity as sim
from keeprank.session import write_and_read
from keeprank.sources import tables as T

NOW = "2024-02-01 00:00:00"


def scored_pairs(spark, d, user_factors, item_factors):
    """Predictions for every stored cell, with biases."""
    mx = matrix(spark, d)
    mean = mx.agg(F.avg("value").alias("m")).scalar()
    return factors.cf_predict(mx.select("user_id", "item_id"), user_factors, item_factors, factors.matrix_bias(mx), mean)


@query("svd_factors")
def svd_factors(spark, d):
    u, i = factors.svd_factors(matrix(spark, d), 8)
    return scored_pairs(spark, d, u, i).select("user_id", "item_id", "prediction")


@query("als_factors")
def als_factors(spark, d):
    u, i = factors.als_factors(matrix(spark, d), rank=8, iterations=3)
    return scored_pairs(spark, d, u, i).select("user_id", "item_id", "prediction")


@query("cf_predict", f"""
WITH {MATRIX_SQL}, {USER_VECTOR_SQL},
g AS (SELECT avg(value) AS m FROM mx),
ub AS (SELECT user_id, sum(value) / (SELECT count(DISTINCT item_id) FROM mx) - (SELECT m FROM g) AS b FROM mx GROUP BY 1),
ib AS (SELECT item_id, sum(value) / (SELECT count(DISTINCT user_id) FROM mx) - (SELECT m FROM g) AS b FROM mx GROUP BY 1)
SELECT p.user_id, p.item_id, round(coalesce((SELECT m FROM g) + ub.b + ib.b + list_dot_product(uv.user_vector, v.embedding), (SELECT m FROM g)), 6) AS prediction
FROM history p LEFT JOIN ub USING (user_id) LEFT JOIN ib USING (item_id) LEFT JOIN uv USING (user_id) LEFT JOIN item_vectors v USING (item_id)""")
def cf_predict(spark, d):
    mx = matrix(spark, d)
    users = user_vectors(spark, d).withColumnRenamed("user_vector", "user_factor")
    items = T.item_vectors(spark, d).select("item_id", F.col("embedding").alias("item_factor"))
    out = factors.cf_predict(T.history(spark, d), users, items, factors.matrix_bias(mx), mx.agg(F.avg("value").alias("m")).scalar())
    return out.select("user_id", "item_id", F.round("prediction", 6).alias("prediction"))


TOWER_FEATURES = ["user_id", "user_segment", "price_sensitivity"], ["item_id", "category", "brand", "price_level", "rating_level"]


def trained_towers(spark, d):
    """Towers of the whole history, with the tables of users and items that they read."""
    users = T.users(spark, d).select("user_id", "user_segment", "price_sensitivity")
    items = T.items(spark, d).select("item_id", "category", "brand", F.floor(F.log2(F.col("price") + 1) * 4).alias("price_level"),
                                     F.round("rating").alias("rating_level"))
    known = T.history(spark, d)
    return towers.train(known, users, items, *TOWER_FEATURES, epochs=8), known, users, items


@query("learned_two_tower")
def learned_two_tower(spark, d):
    made, known, users, items = trained_towers(spark, d)
    negatives = sampling.negative_samples(known, T.items(spark, d), 4).select("user_id", "item_id", F.lit(0.0).alias("label"))
    rows = known.select("user_id", "item_id", F.lit(1.0).alias("label")).unionByName(negatives)
    return towers.scores(made, rows, users, items).select("user_id", "item_id", "label", "prediction")


@query("two_tower_vectors")
def two_tower_vectors(spark, d):
    """Unit vectors of all users and items."""
    made, _, users, items = trained_towers(spark, d)
    one = lambda rows, side: made.vectors(rows, side).select(
        F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), F.col(f"{side}_vector").alias("vector"))
    return one(users, "user").unionByName(one(items, "item"))


START, ASOF = "2024-01-01", "2024-01-24"


@query("demand_features", """
WITH sp AS (SELECT item_id, inventory, price AS list_price, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM items),
j AS (SELECT sp.*, coalesce(u.units, 0) AS units, coalesce(u.price, list_price) AS price FROM sp LEFT JOIN daily_units u USING (item_id, day)),
k AS (SELECT *, greatest(0, inventory - coalesce(sum(units) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS on_hand FROM j)
SELECT item_id, day::VARCHAR AS day, units, on_hand, round(price, 6) AS price, (isodow(day) = 1)::INT AS dow_0, (isodow(day) = 7)::INT AS dow_6,
       (day IN (DATE '2024-01-01', DATE '2024-01-15'))::INT AS is_holiday, (price < list_price)::INT AS is_promo, round(price - list_price, 6) AS competitor_delta FROM k""")
def demand_features(spark, d):
    out = demand.demand_features(T.items(spark, d), T.daily_units(spark, d), START, "2024-01-30", ["2024-01-01", "2024-01-15"])
    return out.select("item_id", F.col("day").cast("string").alias("day"), "units", "on_hand", F.round("price", 6).alias("price"), "dow_0", "dow_6",
                      "is_holiday", "is_promo", F.round("competitor_delta", 6).alias("competitor_delta"))


@query("demand_forecast", f"WITH {NAIVE_SQL} SELECT item_id, step, round(units, 6) AS units FROM f")
def demand_forecast(spark, d):
    return naive_forecast(spark, d).select("item_id", F.posexplode("forecast").alias("step", "units")).select(
        "item_id", F.col("step").cast("bigint").alias("step"), F.round("units", 6).alias("units"))


@query("demand_regression")
def demand_regression(spark, d):
    out = demand.regression_forecast(T.daily_units(spark, d), T.items(spark, d), START, ASOF)
    return out.select("item_id", F.posexplode("forecast").alias("step", "units"))


@query("oos_filter", f"""
WITH {NAIVE_SQL}, s AS (SELECT item_id, sum(units) FILTER (step < 7) AS need FROM f GROUP BY 1),
c AS (SELECT DISTINCT user_id, item_id FROM interactions UNION SELECT user_id, item_id FROM history)
SELECT coalesce(round(s.need, 9) >= i.inventory % 40, false) AS runs_out, count(*) AS n FROM c LEFT JOIN s USING (item_id) LEFT JOIN items i USING (item_id) GROUP BY 1""")
def oos_filter(spark, d):
    cand = T.interactions(spark, d).select("user_id", "item_id").unionByName(T.history(spark, d)).distinct()
    stock = T.items(spark, d).select("item_id", (F.col("inventory") % 40).alias("inventory"))
    return demand.with_stock_flag(cand, naive_forecast(spark, d), stock).groupBy("runs_out").agg(F.count("*").alias("n"))


@query("elasticity_fit", """
SELECT p.category, u.user_segment, round(regr_slope(ln(quantity), ln(price)), 6) AS elasticity, count(*) AS n FROM purchases p JOIN users u USING (user_id) GROUP BY ALL""")
def elasticity_fit(spark, d):
    joined = T.purchases(spark, d).join(T.users(spark, d).select("user_id", "user_segment"), "user_id")
    return elasticity.elasticity_fit(joined, ["category", "user_segment"]).withColumn("elasticity", F.round("elasticity", 6))


BIAS_SQL = f"{CENTROID_SQL}, bi AS (SELECT CASE category WHEN 'cat_0' THEN 'baby' WHEN 'cat_1' THEN 'new_home' ELSE 'fitness' END AS event_type, centroid FROM c WHERE category IN ('cat_0', 'cat_1', 'cat_2'))"
FORK_SQL = f"""
{LIFE_SQL}, {USER_VECTOR_SQL}, {BIAS_SQL},
fk AS (SELECT lv.user_id, lv.ref_id, lv.seq, p.p, (1 - least(1, confidence * 0.5)) * uv.user_vector[p.p] + least(1, confidence * 0.5) * bi.centroid[p.p] AS v
       FROM lv JOIN uv USING (user_id) JOIN bi USING (event_type), (SELECT unnest(range(1, 65)) AS p) p)"""


def forked(spark, d):
    vectors = T.item_vectors(spark, d)
    named = F.when(F.col("category") == "cat_0", "baby").when(F.col("category") == "cat_1", "new_home").when(
        F.col("category") == "cat_2", "fitness")
    bias = features.mean_vectors(vectors.withColumn("event_type", named).filter("event_type IS NOT NULL"), "event_type").select(
        "event_type", F.col("mean_vector").alias("bias"))
    # Read once for the user of an event and again for its neighbours or reference.
    users = write_and_read(user_vectors(spark, d).withColumnRenamed("user_vector", "vector"), "user-vectors")
    return users, lifestage.fork_embedding(users, detected_events(spark, d), bias)


@query("fork_embedding", f"WITH {FORK_SQL} SELECT user_id, seq, p - 1 AS pos, round(v, 6) AS value FROM fk")
def fork_embedding(spark, d):
    _, out = forked(spark, d)
    return out.select("user_id", "seq", F.posexplode("forked").alias("pos", "value")).select(
        "user_id", "seq", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("propagate_fork", f"""
WITH {FORK_SQL},
nb AS (SELECT a.user_id, b.user_id AS neighbor_id, round(list_cosine_similarity(a.user_vector, b.user_vector), 9) AS similarity FROM uv a JOIN uv b ON a.user_id <> b.user_id),
n2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbor_id) AS rn FROM nb),
mv AS (SELECT n2.neighbor_id, fk.p, (1 - similarity * 0.3) * uv.user_vector[fk.p] + similarity * 0.3 * fk.v AS v
       FROM n2 JOIN fk USING (user_id) JOIN uv ON uv.user_id = n2.neighbor_id WHERE rn <= 20)
SELECT neighbor_id, p - 1 AS pos, round(avg(v), 6) AS value FROM mv GROUP BY ALL""")
def propagate_fork(spark, d):
    users, forks = forked(spark, d)
    near = sim.vector_join(users, users, "user_id", "user_id", "vector", "vector", k=20, same_table=True).select(
        "user_id", F.col("user_id_b").alias("neighbor_id"), "similarity")
    out = lifestage.propagate_fork(forks.select("user_id", "forked"), near, users)
    return out.select("neighbor_id", F.posexplode("vector").alias("pos", "value")).select(
        "neighbor_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("mood_vector", f"""
WITH r AS (SELECT *, {engine_case('hour(ts)', '(isodow(ts) - 1)', 'false')} AS context, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM interactions),
w AS (SELECT r.user_id, r.context, pow(2, -((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) / 14) AS w, unnest(v.embedding) AS v, generate_subscripts(v.embedding, 1) AS p
      FROM r JOIN item_vectors v USING (item_id) WHERE rn <= 50)
SELECT user_id, context, p - 1 AS pos, round(sum(w * v) / sum(w), 6) AS value FROM w GROUP BY ALL""")
def mood_vector(spark, d):
    out = learned.mood_vectors(T.interactions(spark, d), T.item_vectors(spark, d), context.context_of(F.col("ts")),
                               F.lit(NOW).cast("timestamp"))
    return out.select("user_id", "context", F.posexplode("mood").alias("pos", "value")).select(
        "user_id", "context", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("linear_attributions", """
WITH m AS (SELECT avg(price) AS p, avg(rating) AS r, avg(inventory) AS v FROM items)
SELECT item_id, round(-0.01 * (price - (SELECT p FROM m)), 9) AS price, round(0.2 * (rating - (SELECT r FROM m)), 9) AS rating, round(0.0005 * (inventory - (SELECT v FROM m)), 9) AS inventory FROM items""")
def linear_attributions(spark, d):
    coefficients = {"price": -0.01, "rating": 0.2, "inventory": 0.0005}
    out = learned.linear_attributions(T.items(spark, d).select("item_id", *coefficients), coefficients)
    return out.select("item_id", *[F.round(F.get("attributions", F.lit(i)), 9).alias(c) for i, c in enumerate(coefficients)])


@query("suspicious_reviews", """
WITH g AS (SELECT seller_id, floor((ts::DATE - DATE '1970-01-01') / 7)::BIGINT AS "window", count(*) AS reviews, stddev_pop(epoch(ts)) AS spread, avg(rating) AS avg_rating, count(DISTINCT ip_group) AS prefixes FROM reviews GROUP BY ALL)
SELECT seller_id, "window", reviews, round(((spread < 86400)::INT + (round(avg_rating, 9) >= 4)::INT + (prefixes::DOUBLE / reviews <= 0.5)::INT) / 3e0 * (reviews >= 2)::INT, 6) AS score FROM g""")
def suspicious_reviews(spark, d):
    return fraud.suspicious_reviews(T.reviews(spark, d)).select(
        "seller_id", F.col("window").cast("bigint").alias("window"), "reviews", F.round("score", 6).alias("score"))


@query("purchase_probability")
def purchase_probability(spark, d):
    rows = T.purchase_lines(spark, d).select(
        "user_id", (~F.col("is_returned")).cast("double").alias("label"), F.log("price").alias("log_price"), "quantity", "discount")
    return learned.logistic_scores(rows, rows, ["log_price", "quantity", "discount"]).groupBy("user_id").agg(
        F.avg("probability").alias("keep_probability"))


@query("top_arms")
def top_arms(spark, d):
    log = pulls(spark, d)
    return bandit.top_arms(log, bandit.linucb_solve(bandit.linucb_fit(log)), 3).select(
        F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("context"), "arm_id", "ucb", "rank")


@query("cold_start")
def cold_start(spark, d):
    """Event users without a purchase history get the best arms for their latest context."""
    log = pulls(spark, d)
    arms = bandit.linucb_solve(bandit.linucb_fit(log))
    latest = log.groupBy("user_id").agg(F.max_by("x", "event_id").alias("x"))
    loyal = T.affinities(spark, d).filter("affinity > 0.3").select("user_id").distinct()
    new = latest.join(loyal, "user_id", "left_anti")
    return new.join(bandit.top_arms(new, arms, 3), "x").select("user_id", "arm_id", "ucb", "rank")


__all__ = ["S", "md5", "ranking", "scoring"]
