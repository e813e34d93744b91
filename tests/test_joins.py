"""Sampling, vector search, graph and ring operators against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keeprank.operators import bandit, fraud, graph, ring, sampling, similarity


def test_negative_samples(spark):
    items = spark.range(50).withColumnRenamed("id", "item_id")
    pos = [(1, i) for i in range(45)] + [(2, i) for i in range(3)] + [(3, i) for i in range(50)]
    known = spark.createDataFrame(pos, "user_id BIGINT, item_id BIGINT")
    out = sampling.negative_samples(known, items, 10).collect()
    per = {}
    for r in out:
        per.setdefault(r["user_id"], set()).add(r["item_id"])
    assert per[1] == set(range(45, 50)) and len(per[2]) == 10 and 3 not in per
    assert not per[2] & {0, 1, 2}
    again = sampling.negative_samples(known, items, 10).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_next_prime():
    assert [sampling.next_prime(n) for n in (0, 2, 4, 90)] == [2, 2, 5, 97]


def brute(vectors, k=None, floor=None, metric="ip"):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    if metric == "ip":
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        s = m @ m.T
    else:
        s = -np.linalg.norm(m[:, None] - m[None], axis=2)
    s = np.round(s, 9)
    if k is None:
        return {(ids[a], ids[b]) for a, b in itertools.combinations(range(len(ids)), 2) if s[a, b] >= floor}
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_vector_join(spark, metric):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 5))
    vectors = {i: list(centers[i % 6] + rng.normal(scale=0.2, size=5)) for i in range(120)}
    for i in range(120, 160):  # a third of equal copies, and zero vectors
        vectors[i] = vectors[0]
    vectors[160] = vectors[161] = [0.0] * 5
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id BIGINT, embedding ARRAY<DOUBLE>")
    got = similarity.vector_join(df, df, "id", "id", k=7, metric=metric, same_table=True, pivots=8, block_rows=13)
    assert {(r["id"], r["id_b"]) for r in got.collect()} == brute(vectors, 7, metric=metric)
    floor = 0.95 if metric == "ip" else -0.5
    pairs = similarity.vector_join(df, df, "id", "id", min_similarity=floor, metric=metric, same_table=True, pivots=8, block_rows=50)
    rows = [(r["id"], r["id_b"]) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(vectors, floor=floor, metric=metric)
    with pytest.raises(ValueError):
        similarity.vector_join(df, df, "id", "id")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from("abcdefg"), max_size=6), min_size=1, max_size=25), st.sampled_from([0.5, 0.8, 1.0]))
def test_similar_sets(spark, sets, threshold):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id INT, tokens ARRAY<STRING>")
    got = {(r["key_a"], r["key_b"]): (r["n_a"], r["n_b"]) for r in similarity.similar_sets(df, "tokens", threshold).collect()}
    keys = {}
    for s in sets:
        if s:
            keys["|".join(sorted(s))] = keys.get("|".join(sorted(s)), 0) + 1
    want = {}
    for a, b in itertools.combinations_with_replacement(sorted(keys), 2):
        x, y = set(a.split("|")), set(b.split("|"))
        if len(x & y) / len(x | y) >= threshold:
            want[(a, b)] = (keys[a], keys[b])
    assert got == want


def test_taste_neighbors(spark):
    rng = random.Random(5)
    people = []
    for i in range(60):
        cats = sorted(rng.sample("abcdef", rng.randrange(0, 6))) if i % 3 else ["a", "b", "c"]
        vec = [rng.gauss(0, 1) for _ in range(3)] if i % 4 == 0 else None
        people.append((i, vec, cats))
    df = spark.createDataFrame(people, "user_id BIGINT, embedding ARRAY<DOUBLE>, cats ARRAY<STRING>")

    def sim(p, q):
        if p[1] is not None and q[1] is not None:
            a, b = np.array(p[1]), np.array(q[1])
            return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
        x, y = set(p[2]), set(q[2])
        return len(x & y) / len(x | y) if x and y else 0.0

    want = set()
    for p in people:
        near = sorted(((-sim(p, q), q[0]) for q in people if q[0] != p[0] and sim(p, q) >= 0.8))[:4]
        want |= {(p[0], n) for _, n in near}
    got = {(r["user_id"], r["neighbor_id"]) for r in similarity.taste_neighbors(df, 4).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}


def test_rings_of_sellers(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "seller_a BIGINT, seller_b BIGINT")
    out = {r["seller_id"]: (r["ring_id"], r["ring_size"]) for r in fraud.fraud_rings(pairs).collect()}
    assert out == {1: (1, 3), 2: (1, 3), 3: (1, 3), 8: (8, 2), 9: (8, 2)}


def test_neighbors_hub(spark):
    """A hub with many edges gives the same answer as walking every edge."""
    rng = random.Random(9)
    edges = [("hub", f"n{i}", "t", float(rng.randrange(5))) for i in range(400)] + [(f"n{i}", f"m{i % 7}", "t", 1.0) for i in range(400)]
    df = spark.createDataFrame(edges, "src STRING, dst STRING, edge_type STRING, weight DOUBLE")
    seeds = spark.createDataFrame([("hub",), ("m0",), ("n3",)], "node_id STRING")
    got = {(r["seed"], r["hop"], r["neighbor"]) for r in graph.neighbors(df, seeds, 2, 5, ["t"]).collect()}
    adj = {}
    for a, b, _, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    want = set()
    for s in ("hub", "m0", "n3"):
        seen, front = {s}, {s}
        for hop in (1, 2):
            best = {}
            for n in front:
                for o, w in adj[n]:
                    if o not in seen:
                        best[o] = max(w, best.get(o, 0))
            top = sorted(best, key=lambda o: (-best[o], o))[:5]
            want |= {(s, hop, o) for o in top}
            front = set(top)
            seen |= front
    assert got == want


def test_graph_edits(spark):
    e = spark.createDataFrame([("u:1", "p:1", "bought", 1.0), ("u:2", "p:1", "bought", 1.0), ("u:2", "p:2", "viewed", 1.0)],
                              "src STRING, dst STRING, edge_type STRING, weight DOUBLE")
    gone = spark.createDataFrame([("u:1",)], "node_id STRING")
    assert graph.remove_nodes(e, gone).count() == 2
    assert {r["node"]: r["degree"] for r in graph.degree(e).collect()}["p:1"] == 2
    assert graph.filter_edges(e, source="u:2", types=["viewed"]).count() == 1
    n = spark.createDataFrame([("a", [1.0, -1.0]), ("b", [3.0, 1.0]), ("c", [-2.0, 2.0])], "node_id STRING, vector ARRAY<DOUBLE>")
    ab = spark.createDataFrame([("a", "b", "t", 1.0)], "src STRING, dst STRING, edge_type STRING, weight DOUBLE")
    out = {r["node_id"]: r["vector"] for r in graph.sage_mean(n, ab, 1).collect()}
    assert out == {"a": [4.0, 0.0], "b": [4.0, 0.0], "c": [0.0, 2.0]}
    w = {r["node_id"]: r["vector"] for r in graph.sage_mean(n, ab, 1, {"t": [[1.0, 0.0]]}, {"t": [[0.0, 2.0]]}, {"t": [0.5]}).collect()}
    assert w["a"] == [1.0 + 2.0 + 0.5]


def test_ring(spark):
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    before, after = ring.virtual_nodes(spark, list(range(10)), 10), ring.virtual_nodes(spark, list(range(11)), 10)
    placed = ring.assign_shard(keys, before, "key")
    assert placed.count() == 1000 and placed.filter("shard IS NULL").count() == 0
    moved = ring.reshard_diff(keys, before, after, "key")
    assert 0 < moved.count() < 400 and {r["new_shard"] for r in moved.collect()} == {10}
    assert sum(r["load"] for r in ring.ring_load(before).collect()) == pytest.approx(1.0)
    reps = ring.assign_replicas(keys, before, "key", 3).collect()
    assert all(1 <= len(r["owners"]) <= 3 and len(set(r["owners"])) == len(r["owners"]) for r in reps)
    first = {r["key"]: r["shard"] for r in placed.collect()}
    assert all(r["owners"][0] == first[r["key"]] for r in reps)


def test_bandit(spark):
    rng = np.random.default_rng(1)
    log = [(f"a{i % 3}", [float(x) for x in rng.integers(0, 4, 2)], float(rng.integers(0, 2))) for i in range(90)]
    df = spark.createDataFrame(log, "arm_id STRING, x ARRAY<DOUBLE>, reward DOUBLE")
    arms = bandit.linucb_solve(bandit.linucb_fit(df, 2))
    state = {}
    for arm, x, reward in log:
        a, b = state.setdefault(arm, (np.eye(2), np.zeros(2)))
        a += np.outer(x, x)
        b += reward * np.array(x)
    got = {r["arm_id"]: r["theta"] for r in arms.collect()}
    for arm, (a, b) in state.items():
        assert got[arm] == pytest.approx(list(np.linalg.solve(a, b)))
    ctx = spark.createDataFrame([([1.0, 2.0],), ([0.0, 1.0],), ([1.0, 2.0],)], "x ARRAY<DOUBLE>")
    best = bandit.top_arms(ctx, arms, 2, block_rows=1).collect()
    assert len(best) == 4
    for r in best:
        a, b = state[r["arm_id"]]
        x = np.array(r["x"])
        assert r["ucb"] == pytest.approx(x @ np.linalg.solve(a, b) + np.sqrt(x @ np.linalg.solve(a, x)), abs=1e-8)
    only = bandit.top_arms(ctx, arms, 2, allowed=spark.createDataFrame([("a1",)], "arm_id STRING"))
    assert {r["arm_id"] for r in only.collect()} == {"a1"}


def test_degree_shuffles_a_pair_once(spark):
    e = spark.createDataFrame([("u:1", "p:1"), ("p:1", "u:1"), ("u:1", "p:2"), ("u:1", "u:1"), ("u:1", "p:1")], "src STRING, dst STRING")
    out = graph.degree(e)
    assert {r["node"]: r["degree"] for r in out.collect()} == {"u:1": 3, "p:1": 1, "p:2": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {kind: [i for i, line in enumerate(plan) if kind in line] for kind in ("Generate", "Aggregate")}
    assert at["Generate"][0] < at["Aggregate"][-1], "both ends are opened after the pairs are distinct"
