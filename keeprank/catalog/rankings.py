"""Rankings and re-rankings (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank.catalog import query
from keeprank.catalog.joins import md5
from keeprank.catalog.projections import BUCKET_SQL, PENALTY_SQL, PROFILE_SQL
from keeprank.functions import scoring
from keeprank.operators import elasticity, ranking, regret, sampling
from keeprank.sources import tables as T


@query("multi_criteria_topk", """
WITH s AS (SELECT item_id, round(0.55 * (rating / 5) + 0.20 * (review_count / 100e0) + 0.10 * least(1, inventory / 100e0) + 0.15 * ((price - 5) / 200), 9) AS score FROM items_with_reviews)
SELECT item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 100""")
def multi_criteria_topk(spark, d):
    scored = T.items_with_reviews(spark, d).select("item_id", F.round(scoring.composite_score(
        F.col("rating") / 5, F.col("review_count") / F.lit(100.0), F.least(F.lit(1.0), F.col("inventory") / F.lit(100.0)),
        (F.col("price") - 5) / 200), 9).alias("score"))
    return ranking.global_top_k(scored, [F.desc("score"), F.asc("item_id")], 100).withColumn("score", F.round("score", 6))


CANDIDATE_SQL = "cd AS (SELECT user_id, item_id, category, price, rating, rating / 5 AS base_score FROM history JOIN items USING (item_id))"


def candidates(spark, d):
    known = T.items(spark, d).select("item_id", "category", "price", "rating")
    return T.history(spark, d).join(known, "item_id").withColumn("base_score", F.col("rating") / 5)


@query("rerank_regret", f"""
WITH p AS ({PROFILE_SQL}), {CANDIDATE_SQL},
s AS (SELECT cd.user_id, cd.item_id, round(cd.base_score * {PENALTY_SQL}, 9) AS score FROM cd LEFT JOIN p ON p.segment = concat(cd.category, ':', {BUCKET_SQL.replace('price', 'cd.price')}))
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s""")
def rerank_regret(spark, d):
    out = regret.rerank_regret(candidates(spark, d), regret.regret_profile(T.purchases(spark, d)))
    return out.select("user_id", "item_id", "score", "rank")


@query("rerank_elasticity", f"""
WITH {CANDIDATE_SQL}, f AS (SELECT user_id, round(regr_slope(ln(quantity), ln(price)), 6) * 3 - 1 AS e FROM purchases GROUP BY 1),
x AS (SELECT cd.*, f.e, CASE WHEN f.e >= -0.5 THEN 0.8::DOUBLE WHEN f.e >= -2.0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS w FROM cd LEFT JOIN f USING (user_id)),
y AS (SELECT *, CASE WHEN e < -2.0 THEN rating / greatest(price, 0.01) ELSE rating END AS v, CASE WHEN e < -2.0 THEN rating ELSE rating * (1 + 0.1 * (5 - price)) END AS q FROM x),
s AS (SELECT user_id, item_id, round(CASE WHEN e IS NULL OR isnan(e) THEN base_score ELSE base_score * (0.5 + 0.5 * ((1 - w) * v + w * q) / greatest(rating, 1)) END, 9) AS score FROM y)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s""")
def rerank_elasticity(spark, d):
    fitted = elasticity.elasticity_fit(T.purchase_lines(spark, d), ["user_id"]).filter(
        "elasticity IS NOT NULL").select("user_id", (F.round("elasticity", 6) * 3 - 1).alias("elasticity"))
    sens = scoring.sensitivity_class(F.col("elasticity"))
    users = fitted.withColumn("weight", elasticity.share_weight(sens))
    out = elasticity.rerank_elasticity(candidates(spark, d).withColumn("score", F.col("base_score")), users)
    return out.select("user_id", "item_id", "score", "rank")


@query("shuffle_training", f"""
SELECT user_id, item_id, rating, {md5('event_id', '42')} AS position FROM interactions""")
def shuffle_training(spark, d):
    from keeprank.functions.hashing import md5_60

    rows = T.interactions(spark, d)
    shuffled = sampling.shuffle_rows(rows, ["event_id"], 8)
    return shuffled.select("user_id", "item_id", "rating", md5_60(F.col("event_id"), 42).alias("position"))
