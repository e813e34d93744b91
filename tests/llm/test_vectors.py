"""Vector operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keeprank.llm import near_vectors as nv
from keeprank.llm import tiles
from keeprank.llm.near_vectors import near_vectors, spherical_kmeans, unit, visits
from keeprank.llm.topk import best_columns, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def naive_top(rows, k):
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    out = {}
    for q, a in rows:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows if c != q and len(a) == len(b))
            out[q] = [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(x for v in out.values() for x in v)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), 0) for i in range(450)]  # many ties
    rows += [(500, None, 0), (600, [1.0, None, 0.0, 0.0], 0), (700, [float("nan")] * 4, 0), (800, [], 0), (None, [1.0] * 4, 0),
             (900, [1.0, 2.0], 0), (901, [3.0, 1.0], 1), (1000, [1.0] * 3, 1)]
    got = sorted(map(tuple, exact_top_k(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert got == naive_top(rows, 10)
    assert exact_top_k(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_large_numbers(spark):
    rows = [(0, [3e12, 1.0], 0), (1, [2e12, 5.0], 0), (2, [-1e4, 1e6], 0)]
    got = {r["vec_id"]: r["score"] for r in exact_top_k(frame(spark, rows), F.col("vec_id") == 0).collect()}
    assert got == {1: 2 ** 63 - 1, 2: -2 ** 63}


def test_best_columns_ties():
    s = np.array([[5.0, 7, 7, 1, 7], [0, 0, 0, 0, 0]])
    assert best_columns(s, 2).tolist() == [[1, 2], [0, 1]]
    assert best_columns(s * 2.0 ** 60, 3).tolist() == [[1, 2, 4], [0, 1, 2]]


def naive_near(rows, threshold=0.98):
    first = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v) and any(v):
            first.setdefault(i, (np.array(v, dtype=np.float32).astype(float), label))
    ids = sorted(first)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (x, p), (y, q) = first[a], first[b]
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    head = {}
    for i in ids:
        if i not in head:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in head:
                    head[j] = i
                    todo += links[j]
    return sorted(((i, len(links.get(i, ())), head.get(i, i), i is None or head.get(i, i) == i) for i, _, _ in rows), key=str)


def vectors(rng):
    rows = []
    for c in range(12):
        center = rng.standard_normal(8)
        for _ in range(15):
            rows.append((len(rows), (center + rng.standard_normal(8) * 0.07).tolist(), c % 3))
    rows += [(len(rows) + j, rows[0][1], 0) for j in range(20)]  # equal vectors
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, rows[0][1], None), (1003, [1.0, 2.0], 0), (1004, [2.0, 4.0], 0),
             (1005, [float("inf")] + [0.0] * 7, 0), (None, rows[0][1], 0), (1006, [1e30] * 8, 1), (1007, [1e-30] * 8, 1)]
    return rows


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nv, "LOOK_ROWS", 11)
    rows = vectors(np.random.default_rng(5))
    got = sorted(map(tuple, near_vectors(frame(spark, rows), cells=5).collect()), key=str)
    assert got == naive_near(rows)
    assert near_vectors(frame(spark, [])).count() == 0


def test_no_cell_with_a_partner_is_left_out():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((400, 6)))
    y = unit(x + rng.standard_normal(x.shape) * 0.06)
    centers = spherical_kmeans(x, 20)
    _, look = visits(x, centers, math.sqrt(2 - 2 * 0.98) + 1e-7)
    home, _ = visits(y, centers, 0.1)
    near = (x * y).sum(1) >= 0.98
    assert near.sum() > 100 and look[np.arange(400), home][near].all()


def test_star_edges_return_no_more_rows_than_ids():
    ids = np.arange(50)
    out = tiles.star_edges(ids, ids, np.ones((50, 50), bool), np.ones(50))
    assert len(out) <= 100 and (out.groupby("id")["to"].min() == 0).all() and out["n"].sum() == 2500


@pytest.mark.parametrize("n", [0, 1, 3])
def test_kmeans_small(n):
    x = unit(np.random.default_rng(0).standard_normal((max(n, 1), 4)))[:max(n, 1)]
    assert len(spherical_kmeans(x, 8)) <= max(n, 1)
