"""Faults that only larger or folder-shaped tables show."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from keeprank.catalog import joins
from keeprank.catalog.joins import TIMING_SQL
from keeprank.catalog.projections import user_vectors
from keeprank.operators import features, fraud, graph, learned, similarity, vector_index
from keeprank.plans import chain, recommend
from keeprank.sources import tables as T
from keeprank.streaming import jobs, runner


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [sorted(map(tuple, QUERIES["stream_latest_embedding"](spark, d).collect())) for d in (source, str(tmp_path))]
    assert rows[0] == rows[1] and rows[0]


def test_stream_without_rows_gives_none(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["stream_latest_embedding"](spark, str(tmp_path)).count() == 0


def vector_table(spark, n=90, width=6):
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 4, (n, width)).astype(float)
    m[n // 2:n // 2 + 12] = m[0]  # one group of equal vectors
    rows = [(i, v.tolist(), [float(i), 1.0]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows + [(n, None, [0.0, 1.0])], "id long, v array<double>, load array<double>")


def linked(m, threshold):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    links = u @ u.T >= threshold - 1e-12
    np.fill_diagonal(links, False)
    return links


def test_a_group_of_many_links_comes_out_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_CELLS", 200)
    _, table = vector_table(spark)
    points = table.filter("v IS NOT NULL").select(F.col("id").alias("i_id"), F.col("v").alias("i_vec"), F.lit(None).cast("array<double>").alias("load"))
    tiles = similarity.Tiles(points.selectExpr("i_id AS q_id", "i_vec AS q_vec"), points, "ip", None, 2.0, 1, 1000)

    def sizes(q_ids, i_ids, load, tiles):
        yield pa.RecordBatch.from_arrays([pa.array([s.size for _, s in tiles], pa.int64())], ["cells"])

    cells = [r[0] for r in tiles.apply(sizes, "cells bigint").collect()]
    assert sum(cells) == 90 * 90 and max(cells) <= 200


def test_threshold_pairs_of_one_dense_block(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_CELLS", 200)
    m, table = vector_table(spark)
    got = {(r[0], r[1]) for r in similarity.vector_join(table, table, "id", "id", "v", "v", min_similarity=0.5, same_table=True).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(linked(m, 0.5))))}


def test_correlations_are_not_cut_before_they_are_rounded(spark):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (30, 12))
    rows = [(int(s), f"1995-{month + 1:02d}-03") for s, per in enumerate(counts) for month, n in enumerate(per) for _ in range(n)]
    reviews = spark.createDataFrame(rows, "seller_id long, day string").withColumn("ts", F.col("day").cast("timestamp"))
    want = np.corrcoef(counts)
    got = {(r[0], r[1]): r[2] for r in fraud.timing_pairs(reviews, F.month("ts") - 1, 12, 0.2).collect()}
    assert set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(want >= 0.2, 1)))}
    assert all(abs(v - want[k]) < 1e-12 for k, v in got.items())


def test_a_seller_with_equal_counts_pairs_with_all_as_in_sql(spark):
    months = {1: [1, 1, 2], 2: [1, 1, 2, 2], 3: list(range(1, 13)), 4: [5, 9, 9], 5: list(range(1, 13)) * 2, 6: [5, 9]}
    rows = [(seller, f"1995-{m:02d}-03") for seller, per in months.items() for m in per]
    reviews = spark.createDataFrame(rows, "seller_id long, day string").withColumn("ts", F.col("day").cast("timestamp"))
    made = fraud.timing_pairs(reviews, F.month("ts") - 1, 12, 0.6).withColumn("correlation", F.round("correlation", 6))
    con = duckdb.connect()
    con.execute("CREATE TABLE reviews (seller_id BIGINT, ts TIMESTAMP)")
    con.executemany("INSERT INTO reviews VALUES (?, ?)", [(seller, f"{day} 00:00:00") for seller, day in rows])
    want = con.execute(f"WITH {TIMING_SQL} SELECT seller_a, seller_b, round(correlation, 6) FROM tp").fetchall()
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want)) and len(want) == 11
    rings = fraud.fraud_rings(fraud.timing_stars(reviews, F.month("ts") - 1, 12, 0.6))
    assert sorted(map(tuple, rings.collect())) == [(seller, 1, 6) for seller in months]


def test_rings_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_CELLS", 100)
    m, table = vector_table(spark)
    links, part = linked(m, 0.8), np.arange(len(m))
    while True:
        least = np.where(links, part[None, :], len(m)).min(axis=1)
        after = np.minimum(part, least)
        if (after == part).all():
            break
        part = after
    stars = similarity.link_stars(table, "id", "v", 0.8, block_rows=25, pivots=3)
    assert stars.count() < links.sum()
    got = {r["seller_id"]: r["ring_id"] for r in fraud.fraud_rings(stars.toDF("seller_a", "seller_b")).collect()}
    assert got == {int(i): int(part[i]) for i in np.flatnonzero(links.any(axis=1))}


def test_neighbour_sums_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_CELLS", 100)
    m, table = vector_table(spark)
    links, load = linked(m, 0.6), np.column_stack([np.arange(len(m)), np.ones(len(m))])
    got = {r["id"]: (r["n"], r["sums"]) for r in similarity.link_sums(table, "id", "v", "load", 2, 0.6, block_rows=25, pivots=3).collect()}
    assert got == {int(i): (int(links[i].sum()), (links[i] @ load).tolist()) for i in np.flatnonzero(links.any(axis=1))}
    state = load
    for _ in range(3):
        n = links.sum(axis=1)
        state = np.where(n[:, None] > 0, (state + links @ state / np.maximum(n, 1)[:, None]) / 2, state)
    scores = fraud.smooth_scores(table.selectExpr("id AS seller_id", "load AS vector"), table.selectExpr("id AS seller_id", "v AS timing"), 2, 0.6)
    for r in scores.filter(f"seller_id < {len(m)}").collect():
        assert np.allclose(r["vector"], state[r["seller_id"]])


def test_spread_keeps_parts_of_seconds(spark):
    rows = [(1, "1997-08-01 00:00:00.9"), (1, "1997-08-03 00:00:00.1"), (2, "1997-08-01 00:00:00"), (2, "1997-08-03 00:00:00")]
    reviews = spark.createDataFrame(rows, "seller_id long, at string").select(
        "seller_id", F.col("at").cast("timestamp").alias("ts"), F.lit(1.0).alias("rating"), F.monotonically_increasing_id().alias("ip_group"))
    got = {r["seller_id"]: r["score"] for r in fraud.suspicious_reviews(reviews).collect()}
    assert abs(got[1] - 1 / 3) < 1e-12 and got[2] == 0


def test_grouped_lists_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id long, embedding array<double>")
    asked = items.filter("item_id % 3 = 0").withColumnRenamed("item_id", "query_id")
    index = vector_index.build_index(items, lists=12)
    found = []
    for group, queries, cells in ((131_072, 4_096, 1 << 21), (60, 64, 50), (1, 64, 50)):
        monkeypatch.setattr(vector_index, "GROUP_ROWS", group)
        monkeypatch.setattr(vector_index, "QUERY_ROWS", queries)
        monkeypatch.setattr(vector_index, "SCORE_CELLS", cells)
        found.append(sorted(map(tuple, vector_index.search_index(index, asked, 5, 4, 20).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 500


def test_near_pairs_of_buckets_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(200 + i, m[0].tolist()) for i in range(30)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    far = np.linalg.norm(u[:, None] - u[None], axis=2)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(far < 0.9, 1)))}
    monkeypatch.setattr(similarity, "TILE_CELLS", 100)
    units = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(u)], ["item_id", "v"])
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=4, seed=42).fit(units)
    want = sorted((r[0], r[1]) for r in model.approxSimilarityJoin(units, units, 0.9, "distance").selectExpr(
        "datasetA.item_id AS a", "datasetB.item_id AS b").filter("a < b").collect())
    some = [sorted((r[0], r[1]) for r in similarity.lsh_pairs(items, 0.9, block_rows=n).collect()) for n in (10, 1000)]
    assert some[0] == some[1] == want and set(want) <= near
    assert all(abs(r["distance"] - far[r["item_a"], r["item_b"]]) < 1e-9 for r in similarity.lsh_pairs(items, 0.9).collect())


def broadcast_scans(df, names):
    """Scans of the named inputs that are broadcast as they are, without a shuffle or a join in between."""
    path, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        path = [(n, text) for n, text in path if n < depth] + [(depth, line)]
        steps = [text for _, text in path if "Exchange" in text or "Join" in text]
        if "FileScan" in line and any(f"/{n}.parquet" in line for n in names) and steps and "BroadcastExchange" in steps[-1]:
            found.append(line)
    return found


def test_contexts_do_not_broadcast_items_or_users(spark):
    """Their files are small for their rows, so 60 copies still pass the threshold and fill the driver."""
    assert broadcast_scans(QUERIES["context_compare"](spark, "/root/testdata/sf0.001"), ["part", "customer"]) == []


def test_logistic_rows_are_made_once(spark):
    """The fit passes over its rows many times; what makes them is not run again for each pass, nor for the scores."""
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(1)
    table = [(i, float(a), float(a + rng.normal() > 0)) for i, a in enumerate(rng.normal(size=300))]
    rows = spark.createDataFrame(table, "id long, a double, label double").mapInArrow(mark, "id long, a double, label double")
    got = {r["id"]: r["probability"] for r in learned.logistic_scores(rows, rows, ["a"]).collect()}
    assert made.value == 300 and len(got) == 300
    order = sorted(table, key=lambda r: r[1])
    assert got[order[0][0]] < 0.2 and got[order[-1][0]] > 0.8 and sorted(got.values()) == [got[r[0]] for r in order]


def test_returns_are_matched_step_by_step(spark, tmp_path, monkeypatch):
    """Steps in the order of the times give the rows of one step, and the state holds what the watermark covers, not the whole table."""
    start = dt.datetime(2024, 1, 1)
    days = lambda n: start + dt.timedelta(days=n)
    gap = lambda i: i * 7 % 45
    bought = spark.createDataFrame([(i, days(i // 3)) for i in range(1_200)], "user_id long, purchase_ts timestamp")
    back = spark.createDataFrame([(i, days(i // 3 + gap(i))) for i in range(0, 1_200, 2)], "user_id long, return_ts timestamp")
    far = dt.datetime(2200, 1, 1)
    want = {i: days(i // 3 + gap(i)) if i % 2 == 0 and gap(i) <= 30 else None for i in range(1_200)}
    monkeypatch.setattr(runner, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    out = runner.run_in_order([(bought, "purchase_ts", [-1, far]), (back, "return_ts", [-2, far])],
                              lambda p, r: jobs.match_returns(p, r, ["user_id"], 30), "matched", rows_per_step=300)
    rows = [r for r in out.collect() if r["user_id"] >= 0]
    assert len(rows) == 1_200 and {r["user_id"]: r["return_ts"] for r in rows} == want
    batches = [int(p.name) for p in (tmp_path / "matched" / "log" / "commits").iterdir() if p.name.isdigit()]
    held = [spark.read.format("statestore").option("joinSide", "left").option("batchId", n).load(f"{tmp_path}/matched/log").count() for n in batches]
    assert len(batches) > 5 and 0 < max(held) < 500


def test_purchase_lines_of_the_graph_are_joined_once(spark):
    plan = graph.commerce_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "lineitem.parquet" not in plan


def test_distinct_links_of_both_directions(spark):
    rows = [("a", "b", "x"), ("b", "a", "x"), ("a", "b", "y"), ("c", "c", "x"), ("a", "b", "x"), (None, "d", "x")]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string")
    want = sorted(map(str, graph.undirected(edges).select("node", "nbr", "edge_type").distinct().collect()))
    assert sorted(map(str, graph.distinct_links(edges, "edge_type").collect())) == want


def test_vector_join_returns_products_of_the_vectors_as_given(spark):
    m, table = vector_table(spark)
    got = similarity.vector_join(table, table.withColumnRenamed("id", "other"), "id", "other", "v", "v", k=5, pivots=4, block_rows=20, product=True).collect()
    assert len(got) == 5 * len(m) and all(abs(r["product"] - m[r["id"]] @ m[r["other"]]) < 1e-9 for r in got)


def test_injected_items_bring_their_own_columns(spark):
    df = spark.createDataFrame([(1, i, 10.0 - i, float(i), None) for i in range(8)], "user_id int, item_id int, score double, inventory double, _need double")
    pool = spark.createDataFrame([(1, 50, 1, 3.0, 4.0)], "user_id int, item_id int, pool_rank int, inventory double, _need double")
    out = {r["item_id"]: (r["inventory"], r["_need"]) for r in df.transform(chain.discovery_step(pool, carry=["inventory", "_need"])).collect()}
    assert out == {i: (float(i), None) for i in (0, 1, 2, 3, 4, 5, 7)} | {50: (3.0, 4.0)}
    left = df.transform(chain.discovery_step(pool, carry=["inventory", "_need"])).transform(chain.stock_step(None))
    assert {r["item_id"] for r in left.collect()} == {0, 1, 2, 3, 4, 5, 7}


def test_unseen_pool_equals_all_pairs(spark, monkeypatch):
    """Users of no, some and all categories, one with most of a category; short lists end before k rows."""
    monkeypatch.setattr(recommend, "CHUNK", 4)
    rng = np.random.default_rng(4)
    kinds = [*"aaaaaaaabbbbbbbbbbcccdddddddddd"] * 2
    items = [(i, c, float(rng.integers(10, 51) / 10)) for i, c in enumerate(kinds)]
    owned = {(u, int(i)) for u in range(1, 30) for i in rng.integers(0, len(items), int(rng.integers(1, 25)))}
    owned |= {(30, i) for i, c in enumerate(kinds) if c in "ab"} | {(31, i) for i in range(len(items) - 5)}
    catalogue = spark.createDataFrame(items, "item_id long, category string, rating double")
    bought = spark.createDataFrame(sorted(owned), "user_id long, item_id long")
    tastes = T.affinities_of(bought.join(catalogue, "item_id").withColumn("n", F.lit(1)), "items")
    users = spark.range(32).withColumnRenamed("id", "user_id")
    share = {(r["user_id"], r["category"]): r["affinity"] for r in tastes.collect()}
    for k, distance in ((3, 0.6), (14, 0.75)):
        want = {}
        for u in range(32):
            far = [(-round(r / 5 * (1 - share.get((u, c), 0.0)), 9), i) for i, c, r in items
                   if (u, i) not in owned and 1 - share.get((u, c), 0.0) >= distance]
            want |= {(u, i): n + 1 for n, (_, i) in enumerate(sorted(far)[:k])}
        got = chain.unseen_pool(users, bought, tastes, catalogue, k, distance).collect()
        assert {(r["user_id"], r["item_id"]): r["pool_rank"] for r in got} == want and len(got) == len(want)


def test_discoveries_reach_the_result_of_ranking_chain_full(spark):
    d = "/root/testdata/sf0.01"
    vectors = {r[0] for r in T.item_vectors(spark, d).select("item_id").collect()}
    owned = {tuple(r) for r in T.history(spark, d).collect()}
    rows = [(r["user_id"], r["item_id"]) for r in QUERIES["ranking_chain_full"](spark, d).collect()]
    assert [r for r in rows if r[1] not in vectors] and not owned.intersection(rows) and len(set(rows)) == len(rows)


def test_means_of_items_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(7, [1.0] * 5), (8, None)],
                                    "item_id long, embedding array<double>")
    pairs = spark.createDataFrame([(int(u), int(i)) for u in range(30) for i in rng.integers(0, 60, 20)] + [(99, 59), (None, 3)],
                                  "user_id long, item_id long")
    want = {r[0]: r[1] for r in features.mean_vectors(pairs.distinct().join(vectors, "item_id"), "user_id").collect()}
    for name, size in (("BLOCK_PAIRS", 100), ("BLOCK_ITEMS", 9), ("STEP_PAIRS", 7)):
        got = {r[0]: r[1] for r in features.mean_of_items(pairs, vectors, "user_id").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in got)
        monkeypatch.setattr(features, name, size)


def test_ranking_chain_full_joins_lines_once_and_asks_one_cell_of_few_items(spark, monkeypatch):
    calls, cells = [], []
    lines, join = T.purchase_lines, similarity.vector_join
    monkeypatch.setattr(T, "purchase_lines", lambda *a: calls.append(a) or lines(*a))
    monkeypatch.setattr(similarity, "vector_join", lambda *a, **kw: cells.append(kw.get("pivots", 32)) or join(*a, **kw))
    assert QUERIES["ranking_chain_full"](spark, "/root/testdata/sf0.001").columns == ["user_id", "item_id", "score", "rank", "explanation"]
    assert len(calls) == 1 and cells == [1]


def test_stream_match_returns_joins_lines_once_and_lets_old_state_go(spark, monkeypatch):
    plans, kept = [], []
    run, append = runner.run_in_order, runner.run_append
    monkeypatch.setattr(runner, "run_in_order", lambda ends, *a: plans.extend(
        end[0]._jdf.queryExecution().optimizedPlan().toString() for end in ends) or run(ends, *a, rows_per_step=2_000))
    monkeypatch.setattr(runner, "run_append", lambda *a: kept.append([spark.conf.get(c) for c in runner.SHORT_LIVED]) or append(*a))
    before = [spark.conf.get(c) for c in runner.SHORT_LIVED]
    rows = QUERIES["stream_match_returns"](spark, "/root/testdata/sf0.001").count()
    assert rows == T.purchase_lines(spark, "/root/testdata/sf0.001").count() and not [p for p in plans if "Join" in p]
    assert len(kept) > 2 and all(k == list(runner.SHORT_LIVED.values()) for k in kept) and before == [spark.conf.get(c) for c in runner.SHORT_LIVED]


def test_taste_graph_vectors_sends_a_vector_once_a_block(spark, monkeypatch):
    """Not once for each cell that a wide threshold makes it visit."""
    sent, made = [], similarity.Tiles.apply
    monkeypatch.setattr(similarity.Tiles, "apply", lambda self, *a, **kw: sent.append(self.rows.count()) or made(self, *a, **kw))
    users = user_vectors(spark, "/root/testdata/sf0.01").count()
    QUERIES["taste_graph_vectors"](spark, "/root/testdata/sf0.01")
    assert sent == [2 * users * joins.TASTE_SPLIT]


def test_life_stage_report_reads_events_twice_and_few_lines(spark, monkeypatch):
    """Once for the activity and once for the vectors; lines of the compared users alone are joined."""
    calls, users = [], []
    log, lines = T.interactions, T.purchase_lines
    monkeypatch.setattr(T, "interactions", lambda *a: calls.append(a) or log(*a))
    monkeypatch.setattr(T, "purchase_lines", lambda *a: users.append(len(a)) or lines(*a))
    plan = QUERIES["life_stage_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 2 and users == [3] and "props" not in plan


def test_lines_of_chosen_users(spark):
    d = "/root/testdata/sf0.001"
    users = spark.createDataFrame([(3,), (3,), (7,), (None,)], "user_id long")
    want = sorted(map(tuple, T.purchase_lines(spark, d).filter("user_id IN (3, 7)").collect()), key=str)
    assert sorted(map(tuple, T.purchase_lines(spark, d, users).collect()), key=str) == want and want
