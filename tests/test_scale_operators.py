"""Operators that iterate over tables, against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keeprank.operators import factors, graph


def low_rank(seed, users=70, items=50, rank=5):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((users, rank)) @ np.diag(2.0 ** -np.arange(rank)) @ rng.standard_normal((rank, items))
    m[np.abs(m) < 0.2] = 0.0
    m[3, :] = rng.standard_normal(items)  # a row and a column with every cell
    m[:, 4] = rng.standard_normal(users)
    return m


@pytest.mark.parametrize("k, salt", [(4, 10)])
def test_svd_equals_numpy(spark, monkeypatch, k, salt):
    monkeypatch.setattr(factors, "SALT_CELLS", salt)
    m = low_rank(k)
    rows = [(int(u), f"i{i:02d}", float(m[u, i])) for u, i in zip(*np.nonzero(m))]
    table = spark.createDataFrame(rows, "user_id long, item_id string, value double").repartition(5)
    u, v = factors.svd_factors(table, k, rounds=8)
    left, right = np.zeros((70, min(k, 50))), np.zeros((50, min(k, 50)))
    for r in u.collect():
        left[r["user_id"]] = r["user_factor"]
    for r in v.collect():
        right[int(r["item_id"][1:])] = r["item_factor"]
    U, s, V = np.linalg.svd(m, full_matrices=False)
    k = min(k, 50)
    assert np.allclose(left @ right.T, (U[:, :k] * s[:k]) @ V[:k], atol=1e-3)
    assert np.allclose(right.T @ right, np.eye(k), atol=1e-8) and np.allclose(np.linalg.norm(left, axis=0), s[:k], rtol=1e-4)


def test_svd_of_little_rank(spark):
    table = spark.createDataFrame([(u, i, float((u + 1) * (i + 1))) for u in range(6) for i in range(4)], "user_id long, item_id long, value double")
    u, v = factors.svd_factors(table, 3)
    left = {r[0]: np.array(r[1]) for r in u.collect()}
    right = {r[0]: np.array(r[1]) for r in v.collect()}
    assert all(abs(left[a] @ right[b] - (a + 1) * (b + 1)) < 1e-9 for a in range(6) for b in range(4))


def test_tree_qr(spark, monkeypatch):
    monkeypatch.setattr(factors, "BRANCH", 3)
    x = np.random.default_rng(0).standard_normal((500, 6))
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(23)
    r = factors.tree_qr(table, 6)
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(r, np.triu(r))


def naive_components(edges):
    head = {}
    for a, b in edges:
        head.setdefault(a, a), head.setdefault(b, b)

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    return sorted((n, root(n)) for n in head)


def graphs():
    rng = np.random.default_rng(8)
    yield "random", [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))]
    yield "chain", [(i, i + 1) for i in range(300)]
    order = rng.permutation(300).tolist()
    yield "shuffled chain", list(zip(order, order[1:]))
    yield "hub", [(500, i) for i in range(400)] + [(i, i + 1) for i in range(1000, 1010)]
    yield "loops", [(1, 1), (2, 3), (3, 2), (2, 3), (5, 5), (5, 1)]
    yield "none", []


@pytest.mark.parametrize("name, edges", list(graphs()))
def test_components(spark, name, edges):
    table = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.connected_components(table).collect())) == naive_components(edges)


def test_components_of_text_ids(spark):
    table = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "a string, b string")
    assert sorted(map(tuple, graph.connected_components(table).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_a_hub_is_spread(spark):
    """Half of all links lead to one node; no task gets more than a few times the median."""
    links = spark.createDataFrame([(0, i) for i in range(1, 20_000)] + [(2 * i, 2 * i + 1) for i in range(20_000, 40_000)], "u long, v long")
    dealt = links.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(graph.HUB_BUCKETS))).repartition(32, "u", "bucket")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
