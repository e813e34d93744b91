"""Join operators (2.3), set operations (2.7) and ring/membership checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.catalog import query
from keeprank.catalog.projections import USER_VECTOR_SQL, user_vectors
from keeprank.operators import elasticity, features, graph, membership, ranking, regret, ring, sampling
from keeprank.operators import fraud, lifestage
from keeprank.operators import similarity as sim
from keeprank.session import write_and_read
from keeprank.sources import tables as T

MD5 = "concat('0x', substr(md5({}), 1, 15))::BIGINT"


def md5(*parts: str) -> str:
    return MD5.format("concat_ws(':', " + ", ".join(f"{p}::VARCHAR" for p in parts) + ")")


@query("match_returns", """
WITH r AS (SELECT user_id, item_id, purchase_ts, max((return_ts, regret_rating)) AS r FROM purchases WHERE is_returned GROUP BY ALL),
p AS (SELECT user_id, item_id, order_id, seq, price, purchase_ts, row_number() OVER (PARTITION BY user_id, item_id, purchase_ts ORDER BY seq DESC, order_id DESC, price DESC) AS rn FROM purchases)
SELECT p.user_id, count(*) AS lines, count(r.r)::BIGINT AS matched, sum(epoch(r.r[1]))::BIGINT AS ts_sum
FROM p LEFT JOIN r ON p.rn = 1 AND r.user_id = p.user_id AND r.item_id = p.item_id AND r.purchase_ts = p.purchase_ts GROUP BY ALL""")
def match_returns(spark, d):
    lines = T.purchase_lines(spark, d)
    returns = lines.filter("is_returned").select("user_id", "item_id", "purchase_ts", "return_ts", "regret_rating")
    log = lines.select("user_id", "item_id", "order_id", "seq", "price", "purchase_ts")
    return regret.match_returns(log, returns).groupBy("user_id").agg(
        F.count("*").alias("lines"), F.count("return_ts").alias("matched"),
        F.sum(F.unix_seconds("return_ts")).alias("ts_sum"))


@query("match_returns_asof", """
WITH r AS (SELECT user_id, item_id, return_ts FROM purchases WHERE is_returned),
p AS (SELECT DISTINCT user_id, item_id, purchase_ts FROM purchases)
SELECT r.user_id, r.item_id, epoch_us(r.return_ts) // 1000000 AS return_ts,
       CASE WHEN epoch(r.return_ts) - epoch(p.purchase_ts) <= 90 * 86400 THEN epoch_us(p.purchase_ts) // 1000000 END AS purchase_ts
FROM r ASOF LEFT JOIN p ON r.user_id = p.user_id AND r.item_id = p.item_id AND r.return_ts >= p.purchase_ts""")
def match_returns_asof(spark, d):
    lines = T.purchase_lines(spark, d)
    returns = lines.filter("is_returned").select("user_id", "item_id", "return_ts")
    return regret.match_returns_asof(lines, returns).select(
        "user_id", "item_id", F.unix_seconds("return_ts").alias("return_ts"),
        F.unix_seconds("purchase_ts").alias("purchase_ts"))


INDEX_SQL = f"ix AS (SELECT item_id, row_number() OVER (ORDER BY {md5('item_id')}, item_id) - 1 AS idx FROM items)"

def negative_sql(known: str) -> str:
    return f"""
{INDEX_SQL},
pr AS (SELECT min(c) AS p FROM (SELECT unnest(range((SELECT greatest(count(*), 2) FROM items), (SELECT count(*) + 1000 FROM items))) AS c) q
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 2000)) AS z) w WHERE z * z <= c AND c % z = 0)),
u AS (SELECT user_id, {md5('user_id', '42', "'start'")} % p AS a, 1 + {md5('user_id', '42', "'stride'")} % (p - 1) AS b, p
      FROM (SELECT DISTINCT user_id FROM {known}), pr),
s AS (SELECT u.user_id, j.j AS draw, (a + j.j * b) % p AS idx FROM u, (SELECT unnest(range(0, (SELECT p FROM pr))) AS j) j),
c AS (SELECT s.user_id, ix.item_id, row_number() OVER (PARTITION BY s.user_id ORDER BY draw) AS sample_rank
      FROM s JOIN ix USING (idx) LEFT JOIN {known} h ON h.user_id = s.user_id AND h.item_id = ix.item_id WHERE h.item_id IS NULL)"""


NEGATIVE_SQL = negative_sql("history")


@query("negative_samples", f"""
WITH {NEGATIVE_SQL} SELECT user_id, item_id, sample_rank FROM c WHERE sample_rank <= 100""")
def negative_samples(spark, d):
    return sampling.negative_samples(T.history(spark, d), T.items(spark, d))


@query("drop_seen", """
SELECT DISTINCT i.user_id, i.item_id FROM interactions i LEFT JOIN history h ON h.user_id = i.user_id AND h.item_id = i.item_id WHERE h.item_id IS NULL""")
def drop_seen(spark, d):
    seen = T.interactions(spark, d).select("user_id", "item_id").distinct()
    return membership.drop_seen(seen, T.history(spark, d))


BLOOM_N, BLOOM_P = 100_000, 0.05
BITS, HASHES = membership.bloom_size(BLOOM_N, BLOOM_P)
BLOOM_SQL = f"""
k AS (SELECT DISTINCT concat(user_id, ':', item_id) AS key FROM interactions WHERE event_type = 'purchase'),
pos AS (SELECT DISTINCT ({md5('key', '1')} % {BITS} + i * ({md5('key', '2')} % {BITS})) % {BITS} AS position
        FROM k, (SELECT unnest(range(0, {HASHES})) AS i) r)"""


def _pair_key():
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string")).alias("key")


def _bloom(spark, d):
    bought = T.interactions(spark, d).filter("event_type = 'purchase'").select(_pair_key()).distinct()
    return bought, membership.bloom_build(bought, "key", BITS, HASHES)


@query("bloom_seen", f"""
WITH {BLOOM_SQL}, q AS (SELECT DISTINCT concat(user_id, ':', item_id) AS key FROM interactions),
h AS (SELECT key, ({md5('key', '1')} % {BITS} + i * ({md5('key', '2')} % {BITS})) % {BITS} AS position FROM q, (SELECT unnest(range(0, {HASHES})) AS i) r)
SELECT h.key, bool_and(pos.position IS NOT NULL) AS maybe_seen FROM h LEFT JOIN pos USING (position) GROUP BY ALL""")
def bloom_seen(spark, d):
    _, table = _bloom(spark, d)
    return membership.bloom_probe(T.interactions(spark, d).select(_pair_key()), "key", table, BITS, HASHES)


@query("bloom_stats", f"""
WITH {BLOOM_SQL} SELECT round(count(*) / {BITS}::DOUBLE, 9) AS fill_ratio, round(pow(count(*) / {BITS}::DOUBLE, {HASHES}), 9) AS fpr, (SELECT count(*) FROM k) AS inserted FROM pos""")
def bloom_stats(spark, d):
    bought, table = _bloom(spark, d)
    return membership.bloom_stats(table, bought, BITS, HASHES).select(
        F.round("fill_ratio", 9).alias("fill_ratio"), F.round("fpr", 9).alias("fpr"), "inserted")


@query("whitelist_filter", """
WITH s AS (SELECT user_id, item_id, sum(rating) AS score FROM interactions GROUP BY ALL),
f AS (SELECT s.* FROM s JOIN items i USING (item_id) WHERE i.inventory > 500)
SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 5""")
def whitelist_filter(spark, d):
    scored = T.interactions(spark, d).groupBy("user_id", "item_id").agg(F.sum("rating").alias("score"))
    allowed = T.items(spark, d).filter("inventory > 500").select("item_id")
    return membership.whitelist_filter(scored, allowed, 5, ["item_id"])


@query("enrich_candidates", """
SELECT c.user_id, c.cand AS item_id, coalesce(category, 'unknown') AS category, coalesce(price, 10) AS price, coalesce(rating, 3) AS rating,
       coalesce(inventory::DOUBLE, 'infinity'::DOUBLE) > 100 AS well_stocked
FROM (SELECT DISTINCT user_id, item_id * 37 AS cand FROM interactions) c LEFT JOIN items i ON i.item_id = c.cand""")
def enrich_candidates(spark, d):
    from keeprank.plans.chain import enrich

    cand = T.interactions(spark, d).select("user_id", (F.col("item_id") * 37).alias("item_id")).distinct()
    return enrich(cand, T.items(spark, d)).select(
        "user_id", "item_id", "category", "price", "rating", (F.col("inventory") > 100).alias("well_stocked"))


def taste_profiles(spark, d):
    strong = T.affinities(spark, d).filter("affinity >= 0.1").groupBy("user_id").agg(
        F.array_sort(F.collect_set("category")).alias("cats"))
    return T.users(spark, d).select("user_id").join(strong, "user_id", "left").join(
        user_vectors(spark, d).withColumnRenamed("user_vector", "embedding"), "user_id", "left").withColumn(
        "cats", F.coalesce("cats", F.array().cast("array<string>")))


TASTE_SQL = f"""
{USER_VECTOR_SQL},
st AS (SELECT user_id, list_sort(list(category)) AS cats FROM affinities WHERE affinity >= 0.1 GROUP BY 1),
pf AS (SELECT u.user_id, coalesce(st.cats, []) AS cats, uv.user_vector AS vec FROM users u LEFT JOIN st USING (user_id) LEFT JOIN uv USING (user_id))"""


@query("taste_graph", """
WITH st AS (SELECT user_id, list_sort(list(category)) AS cats FROM affinities WHERE affinity >= 0.1 GROUP BY 1),
g AS (SELECT cats, count(*) AS n FROM st GROUP BY 1)
SELECT array_to_string(a.cats, '|') AS key_a, array_to_string(b.cats, '|') AS key_b, a.n AS n_a, b.n AS n_b,
       round(len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))), 6) AS similarity
FROM g a JOIN g b ON array_to_string(a.cats, '|') <= array_to_string(b.cats, '|')
WHERE len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))) >= 0.8""")
def taste_graph(spark, d):
    return sim.similar_sets(taste_profiles(spark, d), "cats", S.TASTE_SIMILARITY).withColumn(
        "similarity", F.round("similarity", 6))


# At most so many users a block, and at least so many blocks a side, so that few users still make many tasks.
TASTE_BLOCK, TASTE_SPLIT = 65_536, 6


@query("taste_graph_vectors", f"""
WITH {USER_VECTOR_SQL}
SELECT a.user_id, b.user_id AS user_id_b, round(round(list_cosine_similarity(a.user_vector, b.user_vector), 9), 6) AS similarity
FROM uv a JOIN uv b ON a.user_id < b.user_id WHERE list_cosine_similarity(a.user_vector, b.user_vector) >= 0.3""")
def taste_graph_vectors(spark, d):
    # The threshold is so wide that users would visit most cells: with one cell they travel once per block instead.
    vectors = write_and_read(user_vectors(spark, d), "user-vectors")
    block = max(1, min(TASTE_BLOCK, -(-vectors.count() // TASTE_SPLIT)))
    return sim.vector_join(vectors, vectors, "user_id", "user_id", "user_vector", "user_vector", min_similarity=0.3,
                           same_table=True, pivots=1, block_rows=block).withColumn("similarity", F.round("similarity", 6))


@query("taste_neighbors", f"""
WITH {TASTE_SQL},
s AS (SELECT a.user_id, b.user_id AS neighbor_id, CASE WHEN a.vec IS NOT NULL AND b.vec IS NOT NULL THEN round(list_cosine_similarity(a.vec, b.vec), 9)
      WHEN len(a.cats) = 0 OR len(b.cats) = 0 THEN 0 ELSE len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))) END AS similarity
      FROM pf a JOIN pf b ON a.user_id <> b.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbor_id) AS rank FROM s WHERE similarity >= 0.8)
SELECT user_id, neighbor_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def taste_neighbors(spark, d):
    return sim.taste_neighbors(taste_profiles(spark, d)).withColumn("similarity", F.round("similarity", 6))


HOP_SQL = """
ud AS (SELECT src AS node, dst AS nbr, edge_type, weight FROM edges WHERE edge_type IN ('sells', 'viewed', 'bought')
       UNION ALL SELECT dst, src, edge_type, weight FROM edges WHERE edge_type IN ('sells', 'viewed', 'bought')),
sd AS (SELECT concat('s:', s_suppkey) AS seed FROM supplier),
h1 AS (SELECT * FROM (SELECT seed, nbr, edge_type, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, nbr, edge_type) AS rank
       FROM (SELECT sd.seed, ud.nbr, ud.edge_type, max(ud.weight) AS weight FROM sd JOIN ud ON ud.node = sd.seed AND ud.nbr <> sd.seed GROUP BY ALL)) WHERE rank <= 50),
f1 AS (SELECT DISTINCT seed, nbr FROM h1),
h2 AS (SELECT * FROM (SELECT seed, nbr, edge_type, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, nbr, edge_type) AS rank
       FROM (SELECT f.seed, ud.nbr, ud.edge_type, max(ud.weight) AS weight FROM f1 f JOIN ud ON ud.node = f.nbr
             WHERE ud.nbr <> f.seed AND NOT EXISTS (SELECT 1 FROM f1 v WHERE v.seed = f.seed AND v.nbr = ud.nbr) GROUP BY ALL)) WHERE rank <= 50)"""


@query("neighbors", f"""
WITH {HOP_SQL}
SELECT seed, nbr AS neighbor, edge_type, weight, rank, 1::BIGINT AS hop FROM h1 UNION ALL SELECT seed, nbr, edge_type, weight, rank, 2::BIGINT FROM h2""")
def neighbors(spark, d):
    seeds = T.raw(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return graph.neighbors(graph.commerce_edges(spark, d), seeds, types=["sells", "viewed", "bought"])


@query("sample_subgraph", f"""
WITH ud AS (SELECT src AS node, dst AS nbr FROM edges UNION SELECT dst, src FROM edges),
dr AS (SELECT node, nbr FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {md5('node', 'nbr', '42')}, nbr) AS rn FROM ud) WHERE rn <= 20),
s1 AS (SELECT dr.* FROM dr WHERE node IN (SELECT concat('s:', s_suppkey) FROM supplier)),
s2 AS (SELECT dr.* FROM dr WHERE node IN (SELECT nbr FROM s1)),
e AS (SELECT DISTINCT least(node, nbr) AS a, greatest(node, nbr) AS b FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2))
SELECT src, dst, edge_type, weight FROM edges JOIN e ON e.a = least(src, dst) AND e.b = greatest(src, dst)""")
def sample_subgraph(spark, d):
    seeds = T.raw(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return graph.sample_subgraph(graph.commerce_edges(spark, d), seeds)


def ring_sql(shards: int = 128) -> str:
    return (f"vn AS (SELECT s AS shard, v AS vnode, {md5('s', 'v')} AS h FROM (SELECT unnest(range(0, {shards})) AS s) a,"
            f" (SELECT unnest(range(0, 100)) AS v) b)")


def _nodes(spark, shards: int = S.SHARDS):
    return ring.virtual_nodes(spark, list(range(shards)))


@query("assign_shard", f"""
WITH {ring_sql()}, k AS (SELECT user_id, {md5('user_id')} AS h FROM users)
SELECT k.user_id, coalesce(vn.shard, (SELECT arg_min(shard, h) FROM vn)) AS shard FROM k ASOF LEFT JOIN vn ON k.h < vn.h""")
def assign_shard(spark, d):
    return ring.assign_shard(T.users(spark, d).select("user_id"), _nodes(spark), "user_id")


@query("assign_replicas", f"""
WITH {ring_sql()}, o AS (SELECT *, row_number() OVER (ORDER BY h, shard) - 1 AS pos FROM vn),
k AS (SELECT user_id, {md5('user_id')} AS h FROM users),
f AS (SELECT k.user_id, coalesce(o.pos, 0) AS pos FROM k ASOF LEFT JOIN o ON k.h < o.h),
x AS (SELECT f.user_id, i, o.shard FROM f, (SELECT unnest(range(0, 3)) AS i) r, o WHERE o.pos = (f.pos + i) % 12800)
SELECT user_id, string_agg(shard::VARCHAR, ',' ORDER BY i) AS shards FROM
 (SELECT user_id, shard, min(i) AS i FROM x GROUP BY ALL) GROUP BY ALL""")
def assign_replicas(spark, d):
    return ring.assign_replicas(T.users(spark, d).select("user_id"), _nodes(spark), "user_id").select(
        "user_id", F.array_join(F.col("owners").cast("array<string>"), ",").alias("shards"))


@query("reshard_diff", f"""
WITH {ring_sql(129)}, k AS (SELECT user_id, {md5('user_id')} AS h FROM users), old AS (SELECT * FROM vn WHERE shard < 128),
a AS (SELECT k.user_id, coalesce(o.shard, (SELECT arg_min(shard, h) FROM old)) AS old_shard FROM k ASOF LEFT JOIN old o ON k.h < o.h),
b AS (SELECT k.user_id, coalesce(v.shard, (SELECT arg_min(shard, h) FROM vn)) AS new_shard FROM k ASOF LEFT JOIN vn v ON k.h < v.h)
SELECT user_id, old_shard, new_shard FROM a JOIN b USING (user_id) WHERE old_shard <> new_shard""")
def reshard_diff(spark, d):
    return ring.reshard_diff(T.users(spark, d).select("user_id"), _nodes(spark), _nodes(spark, S.SHARDS + 1), "user_id")


@query("ring_load", f"""
WITH {ring_sql()}, k AS (SELECT user_id, {md5('user_id')} AS h FROM users),
o AS (SELECT shard, h - coalesce(lag(h) OVER (ORDER BY h), (SELECT max(h) FROM vn) - {1 << 60}) AS arc FROM vn),
l AS (SELECT shard, sum(arc::DOUBLE) / {1 << 60}::DOUBLE AS load FROM o GROUP BY 1),
a AS (SELECT coalesce(vn.shard, (SELECT arg_min(shard, h) FROM vn)) AS shard FROM k ASOF LEFT JOIN vn ON k.h < vn.h)
SELECT l.shard, round(any_value(l.load), 9) AS load, count(a.shard)::BIGINT AS users FROM l LEFT JOIN a USING (shard) GROUP BY 1""")
def ring_load(spark, d):
    nodes = _nodes(spark)
    held = ring.assign_shard(T.users(spark, d).select("user_id"), nodes, "user_id").groupBy("shard").agg(F.count("*").alias("users"))
    return ring.ring_load(nodes).join(held, "shard", "left").select(
        "shard", F.round("load", 9).alias("load"), F.coalesce("users", F.lit(0)).alias("users"))


@query("ring_arcs", f"""
WITH {ring_sql()}, k AS (SELECT user_id, {md5('user_id')} AS h FROM users),
o AS (SELECT shard, vnode, h, coalesce(lead(h) OVER (ORDER BY h), (SELECT min(h) FROM vn) + {1 << 60}) - h AS gap FROM vn),
a AS (SELECT coalesce(vn.shard, (SELECT arg_min(shard, h) FROM vn)) AS shard FROM k ASOF LEFT JOIN vn ON k.h < vn.h),
c AS (SELECT shard, count(*) AS users FROM a GROUP BY 1)
SELECT o.shard, o.vnode::BIGINT AS vnode, o.gap, coalesce(c.users, 0) AS users FROM o LEFT JOIN c USING (shard)""")
def ring_arcs(spark, d):
    nodes = _nodes(spark)
    held = ring.assign_shard(T.users(spark, d).select("user_id"), nodes, "user_id").groupBy("shard").agg(F.count("*").alias("users"))
    return ring.node_gaps(nodes).join(held, "shard", "left").select(
        "shard", F.col("vnode").cast("bigint").alias("vnode"), "gap", F.coalesce("users", F.lit(0)).alias("users"))


@query("feature_lookup", """
WITH p AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, count(*) AS events FROM interactions GROUP BY 1),
q AS (SELECT user_id, count(*) AS lines, round(avg(price), 6) AS avg_price FROM purchases GROUP BY 1)
SELECT u.user_id, p.last_event AS activity__last_event, p.events AS activity__events, q.avg_price AS spend__avg_price
FROM users u LEFT JOIN p USING (user_id) LEFT JOIN q USING (user_id)""")
def feature_lookup(spark, d):
    activity = T.interactions(spark, d).groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("events"))
    spend = T.purchase_lines(spark, d).groupBy("user_id").agg(
        F.count("*").alias("lines"), F.round(F.avg("price"), 6).alias("avg_price"))
    return features.feature_lookup(
        T.users(spark, d).select("user_id"), {"activity": activity, "spend": spend},
        ["activity:last_event", "activity:events", "spend:avg_price"], "user_id")


@query("feature_asof", """
WITH f AS (SELECT user_id, ts, price FROM interactions WHERE event_type = 'purchase'), e AS (SELECT * FROM interactions WHERE event_type = 'view')
SELECT e.user_id, e.event_id, epoch_us(e.ts) // 1000000 AS ts, f.price FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts""")
def feature_asof(spark, d):
    log = T.interactions(spark, d)
    return features.feature_asof(log.filter("event_type = 'view'"), log.filter("event_type = 'purchase'"), "user_id", "price").select(
        "user_id", "event_id", F.floor(F.unix_micros("ts") / 1000000).alias("ts"), "price")


@query("seller_pairs", """
WITH g AS (SELECT seller_id, list_sort(list(DISTINCT ip_group::VARCHAR)) AS cats FROM reviews GROUP BY 1),
k AS (SELECT array_to_string(cats, '|') AS key, any_value(cats) AS cats, count(*) AS n FROM g GROUP BY 1)
SELECT a.key AS key_a, b.key AS key_b, a.n AS n_a, b.n AS n_b,
       round(len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))), 6) AS overlap
FROM k a JOIN k b ON a.key <= b.key WHERE len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))) >= 0.8""")
def seller_pairs(spark, d):
    return fraud.ip_overlap_pairs(T.reviews(spark, d)).withColumn("overlap", F.round("overlap", 6))


TIMING_SQL = """
hc AS (SELECT seller_id, month(ts) AS m, count(*)::DOUBLE AS n FROM reviews GROUP BY ALL),
gr AS (SELECT s.seller_id, r.m, coalesce(hc.n, 0) AS n FROM (SELECT DISTINCT seller_id FROM hc) s CROSS JOIN (SELECT unnest(range(1, 13)) AS m) r LEFT JOIN hc ON hc.seller_id = s.seller_id AND hc.m = r.m),
tp AS (SELECT a.seller_id AS seller_a, b.seller_id AS seller_b, corr(a.n, b.n) AS correlation FROM gr a JOIN gr b ON a.m = b.m AND a.seller_id < b.seller_id GROUP BY ALL HAVING corr(a.n, b.n) >= 0.6)"""


@query("seller_timing_pairs", f"WITH {TIMING_SQL} SELECT seller_a, seller_b, round(correlation, 6) AS correlation FROM tp")
def seller_timing_pairs(spark, d):
    return fraud.timing_pairs(T.reviews(spark, d), F.month("ts") - 1, 12, 0.6).withColumn(
        "correlation", F.round("correlation", 6))


@query("candidate_map", """
SELECT i.item_id, i.seller_id, round(coalesce(r.probability, 0), 6) AS probability FROM items i LEFT JOIN seller_risk r ON r.seller_id = i.seller_id""")
def candidate_map(spark, d):
    risk = T.purchase_lines(spark, d).groupBy("seller_id").agg((F.count_if("is_returned") / F.count("*")).alias("probability"))
    return fraud.candidate_map(T.items(spark, d), risk).select("item_id", "seller_id", F.round("probability", 6).alias("probability"))


@query("category_jaccard", """
WITH a AS (SELECT user_id, list(DISTINCT category) AS cats FROM purchases WHERE is_returned GROUP BY 1),
b AS (SELECT user_id, list(DISTINCT category) AS cats FROM purchases WHERE NOT is_returned GROUP BY 1)
SELECT u.user_id, CASE WHEN a.cats IS NULL OR b.cats IS NULL THEN 0 ELSE round(len(list_intersect(a.cats, b.cats))::DOUBLE / len(list_distinct(list_concat(a.cats, b.cats))), 6) END AS overlap
FROM users u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""")
def category_jaccard(spark, d):
    sets = T.purchases(spark, d).groupBy("user_id").agg(
        F.collect_set(F.when(F.col("is_returned"), F.col("category"))).alias("a"),
        F.collect_set(F.when(~F.col("is_returned"), F.col("category"))).alias("b"))
    empty = F.array().cast("array<string>")
    return T.users(spark, d).select("user_id").join(sets, "user_id", "left").select(
        "user_id", F.round(lifestage.jaccard(F.coalesce("a", empty), F.coalesce("b", empty)), 6).alias("overlap"))


@query("rank_overlap", """
WITH a AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS r FROM interactions WHERE event_type = 'view' GROUP BY 1) WHERE r <= 50),
b AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS r FROM interactions WHERE event_type = 'click' GROUP BY 1) WHERE r <= 50)
SELECT count_if(a.item_id IS NOT NULL AND b.item_id IS NOT NULL)::BIGINT AS shared, count_if(b.item_id IS NULL)::BIGINT AS only_a,
       count_if(a.item_id IS NULL)::BIGINT AS only_b, round(count_if(a.item_id IS NOT NULL AND b.item_id IS NOT NULL)::DOUBLE / count(*), 6) AS jaccard
FROM a FULL JOIN b USING (item_id)""")
def rank_overlap(spark, d):
    from keeprank.operators.metrics import rank_overlap as overlap

    def top(kind):
        counted = T.interactions(spark, d).filter(F.col("event_type") == kind).groupBy("item_id").agg(F.count("*").alias("n"))
        return ranking.global_top_k(counted, [F.desc("n"), F.asc("item_id")], 50).select("item_id")

    return overlap(top("view"), top("click"), "item_id").withColumn("jaccard", F.round("jaccard", 6))


@query("fill_remaining", """
WITH v AS (SELECT user_id, item_id, count(*)::DOUBLE AS score FROM interactions WHERE event_type = 'view' GROUP BY ALL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM v) WHERE rank <= 5),
p AS (SELECT user_id, item_id, sum(rating) AS score FROM interactions GROUP BY ALL),
x AS (SELECT p.* FROM p LEFT JOIN s USING (user_id, item_id) WHERE s.rank IS NULL),
a AS (SELECT user_id, item_id, score, 0 AS late, rank AS pos FROM s UNION ALL SELECT user_id, item_id, score, 1, 0 FROM x)
SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY late, pos, score DESC, item_id) AS rank FROM a) WHERE rank <= 20""")
def fill_remaining(spark, d):
    log = T.interactions(spark, d)
    views = log.filter("event_type = 'view'").groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("score"))
    short = ranking.top_k(views, ["user_id"], [F.desc("score"), F.asc("item_id")], 5)
    pool = log.groupBy("user_id", "item_id").agg(F.sum("rating").alias("score"))
    return membership.fill_remaining(short, pool, 20)
