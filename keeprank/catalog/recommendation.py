"""Composed user-level queries (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.catalog.aggregates import ARM_SQL, DISCOVERY_SQL, POPULARITY_SQL, PREDICTED_SQL, predicted_and_actual
from keeprank.catalog.joins import md5, negative_sql
from keeprank.catalog.learning import FORK_SQL, forked
from keeprank.catalog.projections import (
    BUCKET_SQL, DOW, HOUR, NAIVE_SQL, PAY, PENALTY_SQL, PROFILE_SQL, SHIFT_SQL, SHIFTS, naive_forecast, payday, serving_case,
)
from keeprank.catalog.rankings import candidates as rating_candidates
from keeprank.functions import arrays, context, scoring
from keeprank.operators import elasticity, features, metrics, regret
from keeprank.operators import similarity as sim
from keeprank.operators.ranking import ranked, top_k
from keeprank.plans import chain, recommend as R, reports, training
from keeprank.session import scratch_path, write_and_read
from keeprank.sources import tables as T
from keeprank.sources.interactions import save_training_data

TYPICAL_SQL = "ty AS (SELECT user_id, category FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, category) AS rn FROM affinities) WHERE rn <= 3)"

BASE = ("0.2 * CASE u.price_sensitivity WHEN 'high' THEN greatest(0, 1 - i.price / 200) WHEN 'low' THEN 0.5 + 0.5 * (i.rating / 5) ELSE 0.5 END"
        " + 0.2 * (i.rating / 5)")


def recommend_sql(requests: str, listed: str | None = None) -> str:
    """CTEs ``rs(request_id, user_id, rank, item_id, score, is_discovery)`` by scoring every pair."""
    only = f" AND (rq.request_id NOT IN (SELECT request_id FROM {listed}) OR EXISTS (SELECT 1 FROM {listed} w WHERE w.request_id = rq.request_id AND w.item_id = i.item_id))" if listed else ""
    return f"""
{TYPICAL_SQL}, rq AS ({requests}),
sc AS (SELECT rq.request_id, rq.user_id, rq.k, i.item_id, ty.category IS NOT NULL AS typical,
        round(CASE WHEN h.item_id IS NOT NULL THEN (0.4 * (coalesce(a.affinity, 0) + coalesce(sh.delta, 0)) + ({BASE}) + 0.2) * 0.7
              ELSE 0.4 * (coalesce(a.affinity, 0) + coalesce(sh.delta, 0)) + ({BASE}) END, 9) AS score
       FROM rq JOIN users u ON u.user_id = rq.user_id JOIN items i ON i.inventory > 0{only}
       LEFT JOIN affinities a ON a.user_id = rq.user_id AND a.category = i.category LEFT JOIN ty ON ty.user_id = rq.user_id AND ty.category = i.category
       LEFT JOIN history h ON h.user_id = rq.user_id AND h.item_id = i.item_id LEFT JOIN {SHIFT_SQL} ON sh.context = rq.context AND sh.category = i.category),
nr AS (SELECT *, row_number() OVER w AS nat, sum((NOT typical)::INT) OVER w AS pool, count(*) OVER (PARTITION BY request_id) AS len,
              least(k // 7, sum((NOT typical)::INT) OVER (PARTITION BY request_id)) AS psize FROM sc WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
en AS (SELECT request_id, user_id, k, item_id, nat AS pos, score, false AS d FROM nr WHERE nat <= k AND (nat % 7 <> 0 OR nat // 7 > psize)
       UNION ALL SELECT request_id, user_id, k, item_id, pool * 7, score * 0.9, true FROM nr WHERE NOT typical AND pool <= k // 7 AND pool * 7 <= least(len, k)
       UNION ALL SELECT request_id, user_id, k, item_id, k + nat, score, false FROM nr WHERE nat <= k + k // 7),
dd AS (SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY pos) AS first FROM en),
rs AS (SELECT request_id, user_id, rank, item_id, score, d AS is_discovery FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS rank FROM dd WHERE first = 1) WHERE rank <= k)"""


class Inputs:
    """Shared inputs of the recommendation queries."""

    def __init__(self, spark, d):
        self.items, self.popular, self.users = T.items(spark, d), T.items_with_reviews(spark, d), T.users(spark, d)
        # One pass over the purchases; history and affinities both come from the pair counts.
        self.pairs = write_and_read(T.purchase_lines(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("n")), "pairs")
        self.affinities = T.affinities_of(self.pairs.join(self.items.select("item_id", "category").hint("merge"), "item_id"))
        self.history, self.shifts = self.pairs.select("user_id", "item_id"), context.shift_table(spark, SHIFTS)

    def run(self, requests, listed=None, dedup=True):
        return R.recommend(requests, self.items, self.users, self.affinities, self.history, self.shifts, None, listed,
                           dedup, self.popular)


@query("recommend", f"""
WITH {recommend_sql("SELECT user_id AS request_id, user_id, 'default' AS context, 50 AS k FROM users")}
SELECT user_id, rank, item_id, score, is_discovery FROM rs""")
def recommend(spark, d):
    requests = T.users(spark, d).select(
        F.col("user_id").alias("request_id"), "user_id", F.lit("default").alias("context"), F.lit(S.DEFAULT_TOP_K).alias("top_k"))
    return Inputs(spark, d).run(requests).select("user_id", "rank", "item_id", "score", "is_discovery")


VIEW_REQUESTS_SQL = f"""
SELECT event_id AS request_id, user_id, {serving_case(HOUR, DOW, PAY)} AS context, 10 + event_id % 15 AS k, event_id % 4 AS surface, user_id % 10 = 0 AS fresh FROM interactions WHERE event_type = 'view'"""


def view_requests(spark, d):
    """Every page view asks for a list."""
    ts = F.col("ts")
    return T.interactions(spark, d).filter("event_type = 'view'").select(
        F.col("event_id").alias("request_id"), "user_id", context.context_of(ts, payday(ts), "serving").alias("context"),
        (10 + F.col("event_id") % 15).alias("top_k"), (F.col("event_id") % 4).alias("surface"),
        (F.col("user_id") % 10 == 0).alias("is_new_user"))


POPULAR_SQL = f"(SELECT item_id, category, row_number() OVER (ORDER BY round({POPULARITY_SQL}, 9) DESC, item_id) AS rank FROM items_with_reviews)"


@query("recommend_batch", f"""
WITH vr AS ({VIEW_REQUESTS_SQL}), ls AS (SELECT DISTINCT vr.request_id, i.item_id FROM vr JOIN interactions i USING (user_id) WHERE vr.request_id % 5 = 0),
{recommend_sql("SELECT request_id, user_id, context, k FROM vr WHERE NOT fresh", "ls")},
pf AS (SELECT vr.request_id, vr.user_id, p.rank, p.item_id, CASE WHEN sh.category IS NOT NULL THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score, false AS is_discovery
       FROM vr JOIN {POPULAR_SQL} p ON p.rank <= vr.k LEFT JOIN {SHIFT_SQL} ON sh.context = vr.context AND sh.category = p.category WHERE vr.fresh),
al AS (SELECT * FROM rs UNION ALL SELECT * FROM pf)
SELECT al.request_id, ['homepage', 'product_detail', 'cart', 'post_purchase'][vr.surface + 1] AS surface, al.user_id, al.rank, al.item_id, al.score, al.is_discovery,
       round(avg(al.is_discovery::INT) OVER (PARTITION BY al.request_id), 6) AS discovery_share,
       round(avg((NOT EXISTS (SELECT 1 FROM purchases q WHERE q.user_id = al.user_id AND q.category = i.category AND q.is_returned))::INT) OVER (PARTITION BY al.request_id), 6) AS novelty
FROM al JOIN vr USING (request_id) JOIN items i ON i.item_id = al.item_id""")
def recommend_batch(spark, d):
    from keeprank.schemas import SURFACES

    inputs, requests = Inputs(spark, d), view_requests(spark, d)
    seen = T.interactions(spark, d).select("user_id", "item_id").distinct()
    listed = requests.filter("request_id % 5 = 0").select("request_id", "user_id").join(seen, "user_id").select("request_id", "item_id")
    recs = write_and_read(inputs.run(requests.drop("surface"), listed), "recs")
    known = T.purchases(spark, d).filter("is_returned").select("user_id", "category").distinct()
    cats = recs.join(inputs.items.select("item_id", "category"), "item_id")
    novelty = cats.join(known.withColumn("_k", F.lit(1)), ["user_id", "category"], "left").groupBy("request_id").agg(
        F.round(F.avg(F.col("_k").isNull().cast("double")), 6).alias("novelty"),
        F.round(F.avg(F.col("is_discovery").cast("double")), 6).alias("discovery_share"))
    names = F.array(*[F.lit(s) for s in SURFACES])
    surfaces = requests.select("request_id", F.get(names, F.col("surface").cast("int")).alias("surface"))
    return recs.join(novelty, "request_id").join(surfaces, "request_id").select(
        "request_id", "surface", "user_id", "rank", "item_id", "score", "is_discovery", "discovery_share", "novelty")


@query("ctx_candidates", f"""
WITH s AS (SELECT u.price_sensitivity, i.category, i.item_id, round({BASE}, 9) AS base FROM items i CROSS JOIN (SELECT unnest(['high', 'medium', 'low']) AS price_sensitivity) u WHERE i.inventory > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price_sensitivity, category ORDER BY base DESC, item_id) AS rank FROM s) WHERE rank <= 60""")
def ctx_candidates(spark, d):
    return R.context_candidates(T.items(spark, d).filter("inventory > 0"), 60).select(
        "price_sensitivity", "category", "item_id", F.round("base", 9).alias("base"), F.col("list_rank").alias("rank"))


@query("popular_fallback", f"""
WITH vr AS ({VIEW_REQUESTS_SQL})
SELECT vr.request_id, p.rank, p.item_id, CASE WHEN sh.category IS NOT NULL THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS score
FROM vr JOIN {POPULAR_SQL} p ON p.rank <= vr.k LEFT JOIN {SHIFT_SQL} ON sh.context = vr.context AND sh.category = p.category""")
def popular_fallback(spark, d):
    return R.popular_fallback(view_requests(spark, d), T.items_with_reviews(spark, d), context.shift_table(spark, SHIFTS)).select(
        "request_id", "rank", "item_id", "score")


FIRST_SQL = """
fh AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY min(purchase_ts), item_id) AS rn FROM purchases GROUP BY user_id, item_id) WHERE rn <= 5),
br AS (SELECT DISTINCT user_id, brand FROM fh JOIN items USING (item_id))"""
EXPLAIN_SQL = f"""
{TYPICAL_SQL}, {FIRST_SQL},
pr0 AS (SELECT DISTINCT user_id, item_id FROM interactions UNION SELECT user_id, item_id FROM history),
ex AS (SELECT p.user_id, p.item_id, i.item_id IS NOT NULL AND u.user_id IS NOT NULL AS known, list_filter([
   CASE WHEN coalesce(a.affinity, 0) > 0.3 THEN concat('Similar to ', i.category, ' you browse') END,
   CASE WHEN u.price_sensitivity = 'high' AND i.price < 50 THEN concat('Great value at $', round_even(i.price, 0)::BIGINT) WHEN u.price_sensitivity = 'low' AND i.rating >= 4.5 THEN 'Top-rated in its category' END,
   CASE WHEN i.rating >= 4.5 THEN 'Highly rated by other shoppers' END,
   CASE WHEN br.brand IS NOT NULL THEN concat('You''ve engaged with ', i.brand, ' before') END,
   CASE WHEN ty.category IS NULL THEN 'A fresh discovery for you' END, CASE WHEN ty.category IS NULL THEN 'You might discover something new' END], lambda x: x IS NOT NULL) AS r
  FROM pr0 p LEFT JOIN items i USING (item_id) LEFT JOIN users u USING (user_id) LEFT JOIN affinities a ON a.user_id = p.user_id AND a.category = i.category
  LEFT JOIN ty ON ty.user_id = p.user_id AND ty.category = i.category LEFT JOIN br ON br.user_id = p.user_id AND br.brand = i.brand)"""


def first_items(spark, d):
    firsts = T.purchase_lines(spark, d).groupBy("user_id", "item_id").agg(F.min("purchase_ts").alias("ts"))
    return top_k(firsts, ["user_id"], [F.asc("ts"), F.asc("item_id")], 5).select("user_id", "item_id")


@query("explain", f"""
WITH {EXPLAIN_SQL.replace('> 0.3', '> 0.5')}
SELECT user_id, item_id, CASE WHEN NOT known THEN 'Recommended for you' WHEN len(r) = 0 THEN 'Recommended based on your profile' ELSE array_to_string(r[1:3], ' and ') END AS explanation FROM ex""")
def explain(spark, d):
    aff = T.affinities(spark, d)
    pairs = T.interactions(spark, d).select("user_id", "item_id").unionByName(T.history(spark, d)).distinct()
    return R.explain(pairs, T.items(spark, d), T.users(spark, d), aff, R.typical_categories(aff), first_items(spark, d))


@query("rule_explanation", f"""
WITH {EXPLAIN_SQL.replace('> 0.3', '> 0.5')}
SELECT CASE WHEN NOT known THEN 'Recommended for you' WHEN len(r) = 0 THEN 'Recommended based on your profile' ELSE array_to_string(r[1:3], ' and ') END AS explanation, count(*) AS n FROM ex GROUP BY 1""")
def rule_explanation(spark, d):
    return explain(spark, d).groupBy("explanation").agg(F.count("*").alias("n"))


CHAIN_SQL = f"""
p AS ({PROFILE_SQL}), {NAIVE_SQL}, nd AS (SELECT item_id, round(sum(units) FILTER (step < 7), 9) AS need FROM f GROUP BY 1),
el AS (SELECT user_id, round(regr_slope(ln(quantity), ln(price)), 6) * 3 - 1 AS e FROM purchases GROUP BY 1),
c0 AS (SELECT DISTINCT user_id, (item_id * 7 + user_id * 13) % (SELECT count(*) FROM items) AS item_id FROM interactions),
c1 AS (SELECT c0.user_id, c0.item_id, coalesce(i.category, 'unknown') AS category, coalesce(i.price, 10) AS price, coalesce(i.rating, 3) AS rating, i.inventory % 40 AS inventory, i.seller_id,
              coalesce(i.rating, 3) / 5 AS s0, CASE WHEN isnan(el.e) THEN NULL ELSE el.e END AS e FROM c0 LEFT JOIN items i USING (item_id) LEFT JOIN el USING (user_id)),
c2 AS (SELECT *, CASE WHEN e >= -0.5 THEN 0.8::DOUBLE WHEN e >= -2.0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS w,
              CASE WHEN e < -2.0 THEN rating / greatest(price, 0.01) ELSE rating END AS v, CASE WHEN e < -2.0 THEN rating ELSE rating * (1 + 0.1 * (5 - price)) END AS q FROM c1),
c3 AS (SELECT *, CASE WHEN e IS NULL THEN s0 ELSE s0 * (0.5 + 0.5 * ((1 - w) * v + w * q) / greatest(rating, 1)) END AS s1 FROM c2),
c4 AS (SELECT c3.*, c3.s1 * {PENALTY_SQL} AS s2 FROM c3 LEFT JOIN p ON p.segment = concat(c3.category, ':', {BUCKET_SQL.replace('price', 'c3.price')})),
c5 AS (SELECT c4.*, CASE WHEN coalesce(r.probability, 0) >= 0.35 THEN s2 * 0.1 ELSE s2 END AS s3, CASE WHEN coalesce(r.probability, 0) >= 0.35 THEN s1 * 0.1 ELSE s1 END AS t3
       FROM c4 LEFT JOIN nd USING (item_id) LEFT JOIN seller_risk r ON r.seller_id = c4.seller_id WHERE nd.need IS NULL OR c4.inventory IS NULL OR nd.need < c4.inventory),
c6 AS (SELECT c5.* FROM c5 LEFT JOIN history h USING (user_id, item_id) WHERE h.item_id IS NULL),
c7 AS (SELECT user_id, item_id, round(s3, 9) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(s3, 9) DESC, item_id) AS rank,
              row_number() OVER (PARTITION BY user_id ORDER BY round(t3, 9) DESC, item_id) AS live FROM c6)"""


def chain_lines(spark, d):
    """Purchase lines, joined once for all steps that read them."""
    return write_and_read(T.purchase_lines(spark, d).select(
        "user_id", "item_id", "seller_id", "price", "quantity", "purchase_ts", "is_returned", "return_ts", "regret_rating"), "chain-lines")


def marked_lines(spark, d, users):
    """The same with only what the users' own steps need filled for ``users``, and prices of the others as their buckets."""
    lines = T.purchase_lines(spark, d, None, users)
    return write_and_read(lines.select(
        "item_id", "seller_id", "is_returned", scoring.price_bucket(F.col("price")).alias("bucket"),
        F.when(F.col("return_ts").isNotNull(), F.lit(True)).alias("return_ts"), "regret_rating", "mine",
        *[F.when(F.col("mine"), F.col(c)).alias(c) for c in ("user_id", "price", "quantity", "purchase_ts")]), "chain-lines")


def elasticities(lines):
    fitted = elasticity.elasticity_fit(lines, ["user_id"]).filter(
        "elasticity IS NOT NULL").select("user_id", (F.round("elasticity", 6) * 3 - 1).alias("elasticity"))
    return fitted.withColumn("weight", elasticity.share_weight(scoring.sensitivity_class(F.col("elasticity"))))


def return_shares(lines):
    return lines.groupBy("seller_id").agg((F.count_if("is_returned") / F.count("*")).alias("probability"))


def chain_tables(spark, d, lines):
    """Elasticity per user, regret profile, forecasts and share of returns per seller."""
    profile = regret.regret_profile(T.with_category(spark, d, lines))
    return elasticities(lines), profile, naive_forecast(spark, d), return_shares(lines)


def chain_parts(spark, d):
    n_items = T.items(spark, d).count()
    cand = T.interactions(spark, d).select("user_id", ((F.col("item_id") * 7 + F.col("user_id") * 13) % n_items).alias("item_id")).distinct()
    items = T.items(spark, d).withColumn("inventory", F.col("inventory") % 40)
    rows = chain.enrich(cand, items).withColumn("score", F.col("rating") / 5)
    lines = chain_lines(spark, d)
    feats, profile, forecasts, risk = chain_tables(spark, d, lines)
    steps = {
        "elasticity": chain.elasticity_step(feats),
        "regret": chain.regret_step(profile),
        "stock": chain.stock_step(forecasts),
        "fraud": chain.fraud_step(risk, 0.35),
        "seen": chain.seen_step(lines.select("user_id", "item_id")),
    }
    return rows, steps


@query("ranking_chain", f"WITH {CHAIN_SQL} SELECT user_id, item_id, score, rank FROM c7 WHERE rank <= 50")
def ranking_chain(spark, d):
    rows, steps = chain_parts(spark, d)
    return chain.run_chain(rows, list(steps.values()), 50).select("user_id", "item_id", "score", "rank")


@query("ranking_chain_full")
def ranking_chain_full(spark, d):
    """Vector retrieval, mood score, every step including discovery, and explanations."""
    from keeprank.catalog.projections import user_vectors

    vectors, users = T.item_vectors(spark, d), write_and_read(user_vectors(spark, d), "user-vectors")
    lines, items, k = marked_lines(spark, d, users), T.items(spark, d), 100
    mine = lines.filter("mine")
    feats, risk, forecasts = elasticities(mine), return_shares(lines), naive_forecast(spark, d)
    profile = regret.regret_profile(T.with_category(spark, d, lines), F.concat_ws(":", "category", "bucket"))
    # Everything that depends on the item alone is joined to the items with vectors, not to each user's candidates.
    facts = chain.with_facts(items.join(vectors.select("item_id"), "item_id", "left_semi"), forecasts, risk)
    bias = features.mean_vectors(vectors, "category").withColumnRenamed("mean_vector", "bias")
    leaning = vectors.join(bias, "category").select("item_id", arrays.dot(F.col("bias"), F.col("embedding")).alias("lean"))
    known = write_and_read(regret.with_penalty(chain.enrich(leaning, facts), profile).select(
        "item_id", "lean", "price", "rating", "penalty", "inventory", *chain.ITEM_FACTS), "chain-items")
    near = sim.vector_join(users, vectors, "user_id", "item_id", "user_vector", k=k, product=True, block_rows=5_000,
                           pivots=max(1, min(32, vectors.count() // (50 * k))))
    scored = near.join(known, "item_id").withColumn("score", F.col("product") + F.col("lean")).drop("similarity", "product", "rank", "lean")
    # What the users with candidates bought, with its category; only these users' history matters.
    bought = mine.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.min("purchase_ts").alias("ts"))
    pairs = write_and_read(bought.join(items.select("item_id", "category", F.lit(True).alias("listed")), "item_id", "left"), "chain-pairs")
    aff = write_and_read(T.affinities_of(pairs.filter("listed"), "items"), "chain-affinities")
    carry = ["inventory", *chain.ITEM_FACTS]

    def with_carry(best):
        stock = items.select("item_id", "seller_id", F.col("inventory").cast("double").alias("inventory")).join(
            best.select("item_id"), "item_id", "left_semi").withColumn("inventory", F.coalesce("inventory", F.lit(float("inf"))))
        return best.join(chain.with_facts(stock, forecasts, risk).drop("seller_id"), "item_id")

    # Every seventh of k candidates at most gives way.
    pool = chain.unseen_pool(users, pairs, aff, items, k // S.INJECT_EVERY, carry=with_carry)
    order = [chain.elasticity_step(feats), chain.regret_step(profile), chain.discovery_step(pool, carry=carry),
             chain.stock_step(forecasts), chain.fraud_step(risk, 0.35), chain.seen_step(pairs), chain.once_step()]
    final = chain.run_chain(scored, order, 10).select("user_id", "item_id", "score", "rank")
    firsts = top_k(pairs.select("user_id", "item_id", "ts"), ["user_id"], [F.asc("ts"), F.asc("item_id")], 5).select("user_id", "item_id")
    return R.explain(final, items, T.users(spark, d), aff, R.typical_categories(aff), firsts)


@query("shadow_compare", f"""
WITH {CHAIN_SQL}, s AS (SELECT user_id, item_id, CASE WHEN live <= 10 THEN live END AS l, CASE WHEN rank <= 10 THEN rank END AS v FROM c7 WHERE (live <= 10 OR rank <= 10) AND {md5('user_id', '11')} % 10000 < 5000)
SELECT user_id, count_if(l IS NOT NULL AND v IS NOT NULL)::BIGINT AS shared, round(count_if(l IS NOT NULL AND v IS NOT NULL)::DOUBLE / count(*), 6) AS overlap, coalesce(sum(abs(l - v)), 0)::BIGINT AS places_moved FROM s GROUP BY 1""")
def shadow_compare(spark, d):
    rows, steps = chain_parts(spark, d)
    live = [step for name, step in steps.items() if name != "regret"]
    return chain.shadow_compare(rows, live, list(steps.values()), 10, ratio=0.5).withColumn("overlap", F.round("overlap", 6))


@query("training_set", f"""
WITH ps AS (SELECT user_id, item_id, max(rating) AS rating, max(ts) AS ts FROM interactions WHERE rating > 0 GROUP BY ALL), {negative_sql('ps')},
al AS (SELECT user_id, item_id, rating, ts FROM ps UNION ALL SELECT user_id, item_id, 0, NULL FROM c WHERE sample_rank <= 100)
SELECT al.user_id, al.item_id, al.rating, epoch_us(ts) // 1000000 AS ts, category, {md5('al.user_id', 'al.item_id', '42')} % 10000 < 2000 AS is_test FROM al LEFT JOIN items USING (item_id)""")
def training_set(spark, d):
    rows = training.training_set(T.interactions(spark, d), T.items(spark, d))
    path = scratch_path(spark, "training-set")
    save_training_data(rows, path)
    return spark.read.parquet(path).select(
        "user_id", "item_id", "rating", F.floor(F.unix_micros("ts") / 1000000).alias("ts"), "category", "is_test")


@query("evaluate", f"""
WITH {PREDICTED_SQL}, {DISCOVERY_SQL},
l AS (SELECT user_id, count(*) AS listed FROM pr WHERE rank <= 50 GROUP BY 1), n AS (SELECT user_id, count(*) AS relevant FROM ac GROUP BY 1),
h AS (SELECT user_id, count(*) AS hits FROM (SELECT user_id, item_id FROM pr WHERE rank <= 50) JOIN ac USING (user_id, item_id) GROUP BY 1),
q AS (SELECT user_id, CASE WHEN coalesce(listed, 0) = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / listed END AS pc, coalesce(hits, 0)::DOUBLE / greatest(coalesce(relevant, 0), 1) AS rc FROM l FULL JOIN n USING (user_id) LEFT JOIN h USING (user_id)),
rl AS (SELECT pr.user_id, pr.item_id, pr.rank, (ac.item_id IS NOT NULL)::INT AS rel FROM pr LEFT JOIN ac USING (user_id, item_id)),
rb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, rank) AS best FROM rl),
nd AS (SELECT user_id, sum(CASE WHEN rank <= 50 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 50 THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS idcg FROM rb GROUP BY 1),
ct AS (SELECT {ARM_SQL} AS arm, count_if(event_type = 'click') / greatest(count_if(event_type = 'view'), 1)::DOUBLE AS ctr FROM interactions GROUP BY 1),
cw AS (SELECT coalesce(max(ctr) FILTER (arm = 'treatment'), 0) AS t, coalesce(max(ctr) FILTER (arm = 'control'), 0) AS c FROM ct),
fr AS (SELECT count(*) AS actual, count(f.seller_id) AS found FROM (SELECT DISTINCT seller_id FROM reviews WHERE rating <= 1.1 AND ip_group < 3) a LEFT JOIN (SELECT DISTINCT seller_id FROM reviews WHERE rating >= 4.9 AND ip_group < 3) f USING (seller_id))
SELECT 'ndcg' AS metric, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS value, 0.88::DOUBLE AS target FROM nd
UNION ALL SELECT 'precision', round(avg(pc), 6), NULL FROM q UNION ALL SELECT 'recall', round(avg(rc), 6), NULL FROM q
UNION ALL SELECT 'discovery', round(avg(discovery_score), 6), 0.15 FROM ds
UNION ALL SELECT 'return_rate', round(sum(is_returned::INT)::DOUBLE / count(*), 6), 0.02 FROM purchases
UNION ALL SELECT 'ring_recall', round(CASE WHEN actual = 0 THEN 1 ELSE found::DOUBLE / actual END, 6), 0.95 FROM fr
UNION ALL SELECT 'ctr_lift', round(CASE WHEN c = 0 THEN 0 ELSE (t - c) / c END, 6), 0.30 FROM cw""")
def evaluate(spark, d):
    predicted, actual = predicted_and_actual(spark, d)
    relevance = predicted.join(actual.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left").withColumn(
        "relevance", F.coalesce("_hit", F.lit(0)))
    log = T.interactions(spark, d)
    recs = log.select("user_id", "item_id").join(T.items(spark, d).select("item_id", "category"), "item_id")
    rings = lambda cond: T.reviews(spark, d).filter(cond).groupBy("ip_group").agg(F.collect_set("seller_id").alias("members"))
    out = reports.evaluation_report(
        predicted, actual, relevance, recs, T.purchases(spark, d).filter("is_returned AND price > 40"), log,
        T.purchase_lines(spark, d), (rings("rating >= 4.9 AND ip_group < 3"), rings("rating <= 1.1 AND ip_group < 3")))
    return out.withColumn("value", F.round("value", 6))


@query("return_aware_report", f"""
WITH p AS ({PROFILE_SQL}), cd AS (SELECT user_id, item_id, category, price, rating / 5 AS base_score FROM history JOIN items USING (item_id)),
s AS (SELECT cd.*, {PENALTY_SQL} AS penalty, row_number() OVER (PARTITION BY user_id ORDER BY base_score DESC, item_id) AS o FROM cd LEFT JOIN p ON p.segment = concat(cd.category, ':', {BUCKET_SQL.replace('price', 'cd.price')})),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(base_score * penalty, 9) DESC, item_id) AS n FROM s),
g AS (SELECT category, count(*) AS candidates, avg(penalty) AS avg_penalty, sum(abs(n - o))::BIGINT AS places_moved FROM m GROUP BY 1)
SELECT category, count(*) AS purchases, sum(is_returned::INT)::BIGINT AS returns, round(sum(is_returned::INT)::DOUBLE / count(*), 6) AS return_rate,
       any_value(candidates) AS candidates, round(any_value(avg_penalty), 6)::DOUBLE AS avg_penalty, any_value(places_moved) AS places_moved FROM purchases JOIN g USING (category) GROUP BY 1""")
def return_aware_report(spark, d):
    bought = T.purchases(spark, d)
    return reports.return_aware_report(rating_candidates(spark, d), bought, regret.regret_profile(bought)).select(
        "category", "purchases", "returns", F.round("return_rate", 6).alias("return_rate"), "candidates",
        F.round("avg_penalty", 6).alias("avg_penalty"), "places_moved")


CONTEXTS = ["post_payday", "late_night", "weekend_leisure", "workday_lunch", "default"]


@query("context_compare", f"""
WITH {recommend_sql("SELECT concat(user_id, ':', context) AS request_id, user_id, context, 10 AS k FROM users, (SELECT unnest(" + str(CONTEXTS) + ") AS context) c")},
ca AS (SELECT rs.user_id, split_part(request_id, ':', 2) AS context, i.category, count(*) AS n FROM rs JOIN items i USING (item_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, context ORDER BY n DESC, category) AS rn FROM ca),
s AS (SELECT user_id, context, list(category) AS cats FROM r WHERE rn <= 5 GROUP BY ALL)
SELECT a.user_id, a.context AS context_a, b.context AS context_b, round(len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))), 6) AS overlap
FROM s a JOIN s b ON a.user_id = b.user_id AND a.context < b.context""")
def context_compare(spark, d):
    requests = T.users(spark, d).select("user_id", F.explode(F.array(*[F.lit(c) for c in CONTEXTS])).alias("context")).select(
        F.concat_ws(":", F.col("user_id").cast("string"), "context").alias("request_id"), "user_id", "context", F.lit(10).alias("top_k"))
    inputs = Inputs(spark, d)
    recs = inputs.run(requests).withColumn("context", F.split_part("request_id", F.lit(":"), F.lit(2)))
    return features.context_overlap(recs.join(inputs.items.select("item_id", "category").hint("merge"), "item_id").select(
        "user_id", "context", "category"), 5)


@query("inventory_report", f"""
WITH {NAIVE_SQL}, g AS (SELECT item_id, sum(units) FILTER (step < 7) AS d7, sum(units) FILTER (step < 14) AS d14, sum(units) FILTER (step < 21) AS d21, sum(units) AS d30 FROM f GROUP BY 1),
j AS (SELECT g.*, inventory % 60 AS inv FROM g JOIN items USING (item_id))
SELECT item_id, inv AS inventory, round(d7, 6) AS demand_7, round(least(1, d7 / greatest(inv, 1)), 9)::DOUBLE AS p7, round(least(1, d14 / greatest(inv, 1)), 9)::DOUBLE AS p14,
       round(least(1, d21 / greatest(inv, 1)), 9)::DOUBLE AS p21, round(least(1, d30 / greatest(inv, 1)), 9)::DOUBLE AS p30,
       CASE WHEN round(least(1, d7 / greatest(inv, 1)), 9) > 0.7 THEN 'LOW' WHEN round(least(1, d7 / greatest(inv, 1)), 9) < 0.3 THEN 'OK' ELSE 'Medium' END AS status, round(d7, 9) >= inv AS removed FROM j""")
def inventory_report(spark, d):
    stock = T.items(spark, d).select("item_id", (F.col("inventory") % 60).alias("inventory"))
    joined = naive_forecast(spark, d).join(stock, "item_id")
    need = arrays.slice_sum(F.col("forecast"), 7)
    prob = {n: F.round(scoring.stockout_probability(F.col("forecast"), F.col("inventory"), n), 9) for n in (7, 14, 21, 30)}
    return joined.select("item_id", "inventory", F.round(need, 6).alias("demand_7"), *[c.alias(f"p{n}") for n, c in prob.items()],
                         scoring.stock_status(prob[7]).alias("status"), (F.round(need, 9) >= F.col("inventory")).alias("removed"))


@query("life_stage_report", f"""
WITH {FORK_SQL}, fl AS (SELECT user_id, ref_id, seq, list(v ORDER BY p) AS forked FROM fk GROUP BY ALL)
SELECT lv.user_id, lv.ref_id, lv.seq, lv.event_type, round(lv.confidence, 6)::DOUBLE AS confidence, 1 + row_number() OVER (PARTITION BY lv.user_id ORDER BY lv.seq, lv.event_type) AS version,
       round(list_cosine_similarity(a.user_vector, b.user_vector), 5) AS before, round(list_cosine_similarity(fl.forked, b.user_vector), 5) AS after
FROM lv JOIN fl USING (user_id, ref_id, seq) JOIN uv a ON a.user_id = lv.user_id JOIN uv b ON b.user_id = lv.ref_id""")
def life_stage_report(spark, d):
    users, forks = forked(spark, d)
    ref = users.select(F.col("user_id").alias("ref_id"), F.col("vector").alias("ref_vector"))
    from keeprank.operators.lifestage import fork_versions

    # Vectors end here, so that numbering the versions moves narrow rows.
    compared = forks.drop("bias").join(ref, "ref_id").select(
        "user_id", "ref_id", "seq", "event_type", "confidence",
        F.round(arrays.cosine(F.col("vector"), F.col("ref_vector")), 5).alias("before"),
        F.round(arrays.cosine(F.col("forked"), F.col("ref_vector")), 5).alias("after"))
    return fork_versions(compared.withColumn("detected_at", F.col("seq"))).select(
        "user_id", "ref_id", "seq", "event_type", F.round("confidence", 6).alias("confidence"), "version", "before", "after")


__all__ = ["metrics", "ranked"]
