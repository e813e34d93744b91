"""The compressed vector index against brute force: recall, and how many vectors are read for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keeprank.operators import vector_index as vi
from keeprank.sources import tables as T


def true_nearest(ids, m, k):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return {int(i): set(ids[np.lexsort((ids, -np.round(s, 9)))[:k]].tolist()) for i, s in zip(ids, m @ m.T)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_while_reading_few_vectors(spark, sf):
    v = T.item_vectors(spark, f"/root/testdata/{sf}").filter("embedding IS NOT NULL")
    rows = v.select("item_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    asked = v.select(F.col("item_id").alias("query_id"), "embedding")
    index = vi.build_index(v)
    probes, rerank = vi.tune(index, asked, 10, 0.9)
    got = {}
    for r in vi.search_index(index, asked, 10, probes, rerank).collect():
        got.setdefault(r["query_id"], set()).add(r["item_id"])
    true = true_nearest(ids, m, 10)
    recall = np.mean([len(got[i] & t) / 10 for i, t in true.items()])
    print(sf, "lists", len(index.codec.centers), "probes", probes, "rerank", rerank, "of", len(ids), "recall", recall)
    assert recall >= 0.9 and rerank < 0.25 * len(ids)
    assert index.codes.count() == len(ids)


def test_clustered_vectors_open_few_lists(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vi, "QUERY_ROWS", 30)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((20, 16))
    m = np.repeat(centers, 40, axis=0) + rng.standard_normal((800, 16)) * 0.15
    m[700:] = m[0]  # one group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    asked = items.filter("item_id % 7 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    index = vi.build_index(items, lists=40)
    probes, rerank = vi.tune(index, asked, 10, 0.9)
    assert probes < 20
    got = {}
    for r in vi.search_index(index, asked, 10, probes, rerank).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["similarity"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = np.round(u @ u[q], 9)
        floor = np.sort(s)[-10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s[i] - x) < 1e-8 for _, i, x in found)
        hits += sum(s[i] >= floor for _, i, _ in found)
    assert sorted(got) == [q for q in range(0, 800, 7)] and hits >= 0.9 * 10 * len(got)


def test_empty_index(spark):
    items = spark.createDataFrame([], "item_id long, embedding array<double>")
    assert vi.knn(items.withColumnRenamed("item_id", "query_id"), items, 5).count() == 0


def test_codes_score_like_their_reconstruction():
    x = np.random.default_rng(3).standard_normal((300, 12))
    codec = vi.Codec.fit(x, 9)
    home, codes = codec.encode(x)
    for h in range(9):
        own = np.flatnonzero(home == h)
        back = codec.centers[h] + np.hstack([b[codes[own, j]] for j, b in enumerate(codec.books)])
        assert np.allclose(codec.scores(x[:5], h, codes[own]), vi._unit(x[:5]) @ back.T)


def test_a_list_is_decoded_once_for_all_queries(monkeypatch):
    codec = vi.Codec.fit(np.random.default_rng(0).standard_normal((300, 8)), 3)
    codes, calls, made = np.zeros((50, 2), dtype=np.uint8), [], vi.Codec.decode
    monkeypatch.setattr(vi.Codec, "decode", lambda self, *a: calls.append(a) or made(self, *a))
    assert codec.scores(np.ones((20, 8)), 1, codes).shape == (20, 50) and len(calls) == 1
    assert np.allclose(codec.decode(1, codes)[0], codec.centers[1] + np.concatenate([b[0] for b in codec.books]))
