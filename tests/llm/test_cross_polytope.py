"""Cross-polytope search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import frame, usable

import __spark_entry__ as entry
from keeprank.llm import cross_polytope as cp


def naive(rows, is_query, k=5):
    first = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and any(v):
            v = [float(np.float32(x)) for x in v]
            first[i] = min(first.get(i, v), v)
    out = {}
    for q, a in first.items():
        if is_query(q):
            found = []
            for c, b in first.items():
                if c != q and len(a) == len(b):
                    x, y = np.array(a), np.array(b)
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    found.append((-float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), c))
            out[q] = sorted(found)[:k]
    return out


def rows_of(got):
    out = {}
    for r in got.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_everything_probed_is_exact(spark, monkeypatch):
    """With a target of one and all buckets open the result is the brute-force one, ties and odd rows included."""
    monkeypatch.setattr(cp, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cp, "QUERY_BLOCK", 3)
    monkeypatch.setattr(cp, "SALT_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist(), 0) for i in range(120)]
    rows += [(i, rows[0][1], 0) for i in range(200, 260)]  # a large group of equal vectors
    rows += [(300, None, 0), (301, [0.0] * 6, 0), (302, [float("nan")] * 6, 0), (310, [], 0), (None, rows[0][1], 0), (5, rows[9][1], 0),
             (320, [1.0, 2.0], 0), (321, [2.0, 1.0], 1), (330, [1e30] * 6, 1), (331, [1e-30] * 6, None)]
    vectors = frame(spark, rows)
    monkeypatch.setattr(cp, "tuned", lambda classes, *a: {
        int(r["w"]): (h := cp.Hashes(int(r["w"]), 1, 1 << (r["w"] - 1).bit_length()), h.looks())
        for r in classes.select(F.size("v").alias("w")).distinct().collect()})
    got, want = rows_of(cp.nearest(vectors, F.col("vec_id") % 10 == 0)), naive(rows, lambda q: q % 10 == 0)
    assert sorted(got) == sorted(q for q in want if want[q])
    for q, found in got.items():
        assert [i for i, _ in found] == [i for _, i in want[q]]
        assert np.allclose([s for _, s in found], [-s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_empty(spark):
    assert cp.nearest(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert cp.nearest(frame(spark, [(1, [1.0, 2.0], 0)]), F.col("vec_id") % 2 == 0).count() == 0
    assert cp.nearest(frame(spark, [(2, [1.0, 2.0], 0)]), F.col("vec_id") % 2 == 0).count() == 0


def test_rotation_keeps_lengths_and_angles():
    x = cp.unit(np.random.default_rng(0).standard_normal((20, 13)))
    for _, parts in cp.Hashes(13, 2, 16).rotated(x):
        for y in parts:
            assert np.allclose(y @ y.T, x @ x.T)


def test_first_probe_is_the_own_bucket():
    x = cp.unit(np.random.default_rng(4).standard_normal((50, 16)))
    for h in (cp.Hashes(16, 1, 16), cp.Hashes(16, 2, 4), cp.Hashes(16, 3, 2)):
        own, (bucket, _) = h.of(x), h.probes(x)
        assert all(set(own[i]) <= set(bucket[i][:h.tables]) for i in range(50))
        assert bucket.shape[1] == h.looks() and all(len(set(b)) == len(b) for b in bucket)
        assert own.max() < h.tables * h.buckets


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    d = f"/root/testdata/{sf}"
    got = rows_of(entry.queries()["op12_cross_polytope"](spark, d))
    rows = [(r[0], r[1], 0) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids = np.array([r[0] for r in rows])
    m = cp.unit(np.array([r[1] for r in rows], dtype=float))
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = m @ m[ids == q][0]
        s[ids == q] = -2
        true = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits, total = hits + len(true & {i for i, _ in got[q]}), total + 5
        for i, score in got[q]:
            assert abs(score - s[ids == i][0]) < 1e-12
    print(sf, "recall", hits / total)
    assert hits >= 0.9 * total
