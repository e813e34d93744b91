"""Window operators (2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank.catalog import query
from keeprank.catalog.joins import MD5, md5
from keeprank.catalog.projections import DRIVER_CLUSTERS, NAIVE_SQL, naive_forecast, payday
from keeprank.operators import demand, features, graph, lifestage, membership, metrics, ranking, sampling, timeseries
from keeprank.operators import discovery as disc
from keeprank.session import write_and_read
from keeprank.sources import tables as T

__all__ = ["MD5"]


@query("sample_per_user", f"""
SELECT user_id, item_id, sample_rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {md5('user_id', 'item_id', '42')}, item_id) AS sample_rank FROM history) WHERE sample_rank <= 10""")
def sample_per_user(spark, d):
    return ranking.sample_per_key(T.history(spark, d), ["user_id"], "item_id", 10)


@query("top_k_per_user", """
SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
FROM (SELECT user_id, item_id, sum(rating) AS score FROM interactions GROUP BY ALL)) WHERE rank <= 50""")
def top_k_per_user(spark, d):
    scored = T.interactions(spark, d).groupBy("user_id", "item_id").agg(F.sum("rating").alias("score"))
    return ranking.top_k(scored, ["user_id"], [F.desc("score"), F.asc("item_id")], 50)


DISCOVERY_POOL_SQL = """
rk AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
       FROM (SELECT user_id, item_id, sum(rating) AS score FROM interactions GROUP BY ALL)),
pq AS (SELECT h.user_id, h.item_id, i.rating / 5 AS relevance, 1 - coalesce(a.affinity, 0) AS distance
       FROM history h JOIN items i USING (item_id) LEFT JOIN affinities a ON a.user_id = h.user_id AND a.category = i.category),
po AS (SELECT * FROM (SELECT user_id, item_id, round(relevance * distance, 9) AS serendipity,
       row_number() OVER (PARTITION BY user_id ORDER BY round(relevance * distance, 9) DESC, item_id) AS pool_rank FROM pq WHERE distance >= 0.8) WHERE pool_rank <= 50),
ij AS (SELECT r.user_id, r.rank, coalesce(p.item_id, r.item_id) AS item_id, CASE WHEN p.item_id IS NULL THEN r.score ELSE r.score * 0.9 END AS score, p.item_id IS NOT NULL AS is_discovery
       FROM rk r LEFT JOIN po p ON p.user_id = r.user_id AND (r.rank + r.user_id % 7) % 7 = 0 AND p.pool_rank = (r.rank + r.user_id % 7) // 7)"""


def discovery_pool(spark, d):
    return pool_of(T.history(spark, d).join(T.items(spark, d).select("item_id", "category", "rating"), "item_id"), T.affinities(spark, d))


def pool_of(bought, affinities, carry=()):
    """``bought(user_id, item_id, category, rating)`` with its distance from the user's categories."""
    joined = bought.join(affinities.select("user_id", "category", "affinity"), ["user_id", "category"], "left")
    return joined.select("user_id", "item_id", (F.col("rating") / 5).alias("relevance"),
                         (F.lit(1.0) - F.coalesce("affinity", F.lit(0.0))).alias("distance"), *carry)


def injected(spark, d):
    scored = T.interactions(spark, d).groupBy("user_id", "item_id").agg(F.sum("rating").alias("score"))
    ranked = ranking.ranked(scored, ["user_id"], [F.desc("score"), F.asc("item_id")])
    offsets = ranked.select("user_id", (F.col("user_id") % 7).alias("offset")).distinct()
    return disc.inject_discovery(ranked, disc.discovery_candidates(discovery_pool(spark, d), 0.8), offsets)


@query("discovery_candidates", f"WITH {DISCOVERY_POOL_SQL} SELECT user_id, item_id, round(serendipity, 6) AS serendipity, pool_rank FROM po")
def discovery_candidates(spark, d):
    return disc.discovery_candidates(discovery_pool(spark, d), 0.8).select(
        "user_id", "item_id", F.round("serendipity", 6).alias("serendipity"), "pool_rank")


@query("inject_discovery", f"WITH {DISCOVERY_POOL_SQL} SELECT user_id, rank, item_id, round(score, 6) AS score, is_discovery FROM ij")
def inject_discovery(spark, d):
    return injected(spark, d).withColumn("score", F.round("score", 6))


@query("discovery_windows", f"""
WITH {DISCOVERY_POOL_SQL} SELECT user_id, round(avg(is_discovery::INT) FILTER (rank <= 7), 6) AS share_7, round(avg(is_discovery::INT) FILTER (rank <= 14), 6) AS share_14,
 round(avg(is_discovery::INT) FILTER (rank <= 20), 6) AS share_20 FROM ij GROUP BY 1""")
def discovery_windows(spark, d):
    return metrics.discovery_windows(injected(spark, d)).select(
        "user_id", *[F.round(f"share_{n}", 6).alias(f"share_{n}") for n in (7, 14, 20)])


LIFE_SQL = """
bs AS (SELECT user_id, list(category) AS cats FROM affinities WHERE affinity >= 0.18 GROUP BY 1),
prs AS (SELECT DISTINCT user_id, user_id + 1 AS ref_id FROM interactions),
act AS (SELECT user_id, day(ts) AS seq, category, count(*) AS n FROM interactions JOIN items USING (item_id) GROUP BY ALL),
bt AS (SELECT user_id, seq, list(category) AS cats FROM act GROUP BY ALL),
jc AS (SELECT p.user_id, p.ref_id, bt.seq, a.cats AS own, b.cats AS ref, list_distinct(list_concat(a.cats, bt.cats)) AS now
       FROM prs p JOIN bs a ON a.user_id = p.user_id JOIN bs b ON b.user_id = p.ref_id JOIN bt ON bt.user_id = p.user_id),
dv AS (SELECT user_id, ref_id, seq, len(list_intersect(own, ref))::DOUBLE / len(list_distinct(list_concat(own, ref)))
              - len(list_intersect(now, ref))::DOUBLE / len(list_distinct(list_concat(now, ref))) AS divergence FROM jc),
rd AS (SELECT *, avg(divergence) OVER w AS mean_divergence, count(*) OVER w AS observations FROM dv WINDOW w AS (PARTITION BY user_id, ref_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
cl AS (SELECT * FROM (VALUES ('baby', 0, 'small'), ('baby', 0, 'economy'), ('new_home', 1, 'large'), ('new_home', 1, 'standard'), ('fitness', 2, 'promo')) t(event_type, o, category)),
sh AS (SELECT user_id, seq, event_type, o, sum(n)::DOUBLE AS hit, array_to_string(list_sort(list(category)), ',') AS catalyst FROM act JOIN cl USING (category) GROUP BY ALL),
tt AS (SELECT user_id, seq, sum(n)::DOUBLE AS total FROM act GROUP BY ALL),
be AS (SELECT user_id, seq, event_type, catalyst, hit / total AS share, row_number() OVER (PARTITION BY user_id, seq ORDER BY hit / total DESC, o) AS rn FROM sh JOIN tt USING (user_id, seq)),
lv AS (SELECT rd.user_id, rd.ref_id, rd.seq, rd.mean_divergence, be.event_type, be.catalyst, least(1, be.share * 1.5) AS confidence
       FROM rd JOIN be USING (user_id, seq) WHERE be.rn = 1 AND round(mean_divergence, 9) > 0.05 AND least(1, be.share * 1.5) > 0.6)"""


def divergences(spark, d):
    log = T.interactions(spark, d).select("user_id", "item_id", F.dayofmonth("ts").cast("bigint").alias("seq")).join(
        T.items(spark, d).select("item_id", "category"), "item_id")
    # Written once: pairs, batches and the shares of the clusters all read it.
    activity = write_and_read(log.groupBy("user_id", "seq", "category").agg(F.count("*").alias("n")), "activity")
    pairs = write_and_read(activity.select("user_id", (F.col("user_id") + 1).alias("ref_id")).distinct(), "activity-pairs")
    # Only the purchases of a pair's two users count.
    compared = pairs.select("user_id").unionByName(pairs.select(F.col("ref_id").alias("user_id"))).distinct()
    bought = T.with_category(spark, d, T.purchase_lines(spark, d, compared)).withColumn("n", F.lit(1))
    baseline = T.affinities_of(bought).filter("affinity >= 0.18").groupBy("user_id").agg(F.collect_set("category").alias("cats"))
    batches = activity.groupBy("user_id", "seq").agg(F.collect_set("category").alias("new_cats"))
    return lifestage.divergence_steps(baseline, pairs, batches), activity


def detected_events(spark, d):
    steps, activity = divergences(spark, d)
    clusters = lifestage.cluster_table(spark, DRIVER_CLUSTERS)
    return lifestage.life_events(steps, activity, clusters, threshold=0.05 + 1e-9)


@query("rolling_divergence", f"""
WITH {LIFE_SQL} SELECT user_id, ref_id, seq, round(divergence, 6) AS divergence, round(mean_divergence, 6) AS mean_divergence, round(mean_divergence, 9) > 0.05 AS alarm FROM rd""")
def rolling_divergence(spark, d):
    steps, _ = divergences(spark, d)
    return lifestage.rolling_divergence(steps, threshold=0.05 + 1e-9).select(
        "user_id", "ref_id", "seq", F.round("divergence", 6).alias("divergence"),
        F.round("mean_divergence", 6).alias("mean_divergence"), "alarm")


@query("life_events", f"""
WITH {LIFE_SQL} SELECT user_id, ref_id, seq, event_type, catalyst AS catalyst_categories, round(confidence, 6)::DOUBLE AS confidence FROM lv""")
def life_events(spark, d):
    return detected_events(spark, d).select(
        "user_id", "ref_id", "seq", "event_type", F.array_join("catalyst_categories", ",").alias("catalyst_categories"),
        F.round("confidence", 6).alias("confidence"))


@query("fork_version", f"""
WITH {LIFE_SQL} SELECT user_id, seq AS detected_at, event_type, 1 + row_number() OVER (PARTITION BY user_id ORDER BY seq, event_type) AS version FROM lv""")
def fork_version(spark, d):
    events = detected_events(spark, d).withColumnRenamed("seq", "detected_at")
    return lifestage.fork_versions(events).select("user_id", "detected_at", "event_type", "version")


@query("cap_per_hop", """
SELECT node, nbr, edge_type, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, nbr, edge_type) AS rank
FROM (SELECT src AS node, dst AS nbr, edge_type, weight FROM edges UNION ALL SELECT dst, src, edge_type, weight FROM edges)) WHERE rank <= 50""")
def cap_per_hop(spark, d):
    links = graph.undirected(graph.commerce_edges(spark, d)).select("node", "nbr", "edge_type", "weight")
    return ranking.top_k(links, ["node"], [F.desc("weight"), F.asc("nbr"), F.asc("edge_type")], 50)


@query("interaction_sequence", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM interactions)
SELECT user_id, count(*) AS steps, string_agg(concat(item_id, '@', hour(ts), '/', isodow(ts) - 1, '/', (isodow(ts) >= 6)::INT, '/', (day(ts) IN (1, 15))::INT), ' ' ORDER BY ts, event_id) AS path
FROM r WHERE rn <= 50 GROUP BY 1""")
def interaction_sequence(spark, d):
    seq = features.interaction_sequence(T.interactions(spark, d), payday(F.col("ts")))
    text = lambda c: c.cast("string")
    step = lambda s: F.concat(text(s["item_id"]), F.lit("@"), F.concat_ws(
        "/", text(s["hour"]), text(s["weekday"]), text(s["is_weekend"]), text(s["is_payday"])))
    return seq.select("user_id", F.size("steps").cast("bigint").alias("steps"),
                      F.array_join(F.transform("steps", step), " ").alias("path"))


@query("rolling_days", """
WITH u AS (SELECT item_id, day, sum(units)::BIGINT AS units FROM daily_units GROUP BY ALL)
SELECT a.item_id, a.day::VARCHAR AS day, a.units, coalesce((SELECT sum(b.units) FROM u b WHERE b.item_id = a.item_id AND b.day < a.day AND b.day >= a.day - 7), 0)::BIGINT AS rolling FROM u a""")
def rolling_days(spark, d):
    return timeseries.rolling_days(T.daily_units(spark, d), ["item_id"], "units", 7).withColumn("day", F.col("day").cast("string"))


@query("cumulative_demand", f"""
WITH {NAIVE_SQL}, c AS (SELECT item_id, step, inventory % 40 AS inventory, sum(units) OVER (PARTITION BY item_id ORDER BY step) AS cum FROM f JOIN items USING (item_id))
SELECT item_id, round(max(cum), 6) AS total_units, min(step + 1) FILTER (round(cum, 9) >= inventory)::BIGINT AS first_short_day FROM c GROUP BY 1""")
def cumulative_demand(spark, d):
    stock = T.items(spark, d).select("item_id", (F.col("inventory") % 40).alias("inventory"))
    out = demand.cumulative_demand(naive_forecast(spark, d).join(stock, "item_id"))
    return out.withColumn("total_units", F.round("total_units", 6))


@query("inventory_depletion", """
SELECT item_id, day::VARCHAR AS day, greatest(0, inventory - coalesce(sum(units) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS on_hand
FROM daily_units JOIN items USING (item_id)""")
def inventory_depletion(spark, d):
    daily = T.daily_units(spark, d).join(T.items(spark, d).select("item_id", "inventory"), "item_id")
    return demand.inventory_depletion(daily).select("item_id", F.col("day").cast("string").alias("day"), "on_hand")


@query("seen_in_last_slots", """
WITH s AS (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS slot FROM interactions)
SELECT event_id, slot, EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.item_id = a.item_id AND b.slot BETWEEN a.slot - 3 AND a.slot AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS seen_recently FROM s a""")
def seen_in_last_slots(spark, d):
    return membership.seen_in_last_slots(T.interactions(spark, d)).select("event_id", "slot", "seen_recently")


@query("train_test_split", f"""
SELECT event_id, {md5('event_id', '42')} % 10000 < 2000 AS is_test FROM interactions""")
def train_test_split(spark, d):
    return sampling.train_test_split(T.interactions(spark, d), ["event_id"]).select("event_id", "is_test")


@query("train_test_split_time", """
SELECT event_id, percent_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 0.8 AS is_test FROM interactions""")
def train_test_split_time(spark, d):
    return sampling.time_split(T.interactions(spark, d)).select("event_id", "is_test")
