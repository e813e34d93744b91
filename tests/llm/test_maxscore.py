"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from keeprank.llm import maxscore as ms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def naive(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs if i is not None]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    own = {}
    for i, text in items:
        if i is not None:
            own.setdefault(i, set()).update(words(text))
    out = []
    for item, terms in own.items():
        found = []
        for (doc, counts), size in zip(docs, sizes):
            m = 100 - 50 + 50 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * counts[t] // (1000 * counts[t] + 20 * m))
                        for t in terms if counts[t])
            if score > 0:
                found.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frame(spark, rows, name):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"{name} long, text string, score long, term string")


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in ("ab", "Cd", "éf", "x9", "ÑO") for b in "klmnopqrst"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda size: " ".join(rng.choice(vocabulary, size, p=p / p.sum())) + ".\n"
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)]  # copies, so scores tie
    docs += [(2000, None), (2001, ""), (2002, ".,;"), (None, docs[3][1]), (5, docs[9][1]), (5, docs[9][1]), (2003, "abk " * 4000)]
    items = [(i, text(12)) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere else"), (None, "abk"), (3, text(4)), (53, "abk")]
    return docs, items


@pytest.mark.parametrize("k, block", [(50, 16_384), (5, 64)])
def test_rank_documents(spark, monkeypatch, k, block):
    monkeypatch.setattr(ms, "BLOCK_DOCS", block)
    monkeypatch.setattr(ms, "ITEM_ROWS", 9)
    docs, items = corpus(k)
    got = ms.rank_documents(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == naive(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(1, 10)
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, "")])):
        assert ms.rank_documents(frame(spark, d, "doc_id"), frame(spark, i, "item_id")).count() == 0


def lists_of(seed, terms=9, docs=200):
    rng = np.random.default_rng(seed)
    out = {}
    for t in range(terms):
        slots = np.sort(rng.choice(docs, int(rng.integers(1, docs // 2)), replace=False)).astype(np.int32)
        out[t] = slots, rng.integers(0, 1000 * (t + 1), len(slots))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_search_block_and_bounds(seed):
    lists = lists_of(seed)
    dense = np.zeros((len(lists), 200), dtype=np.int64)
    for t, (s, i) in lists.items():
        dense[t, s] = i
    pairs = {(a, b): ms.joint_top(*lists[a], *lists[b], 3)[1] for a in lists for b in range(a + 1, min(a + 4, len(lists)))}
    for (a, b), top in pairs.items():
        both = (dense[a] > 0) & (dense[b] > 0)
        assert top >= (dense[a] + dense[b])[both].max(initial=0)
    tops = [int(lists[t][1].max()) for t in lists]
    bounds = ms.prefix_bounds(tops, lambda i, j: pairs.get((i, j), 0))
    for j in range(len(lists) + 1):
        assert dense[:j].sum(axis=0).max() <= bounds[j] <= sum(tops[:j])
    want = sorted(((-int(s), d) for d, s in enumerate(dense.sum(axis=0)) if s > 0))[:10]
    [(_, slots, scores)] = ms.search_block([(0, list(lists), 0)], lists, pairs, 200, 10)
    assert list(zip((-scores).tolist(), slots.tolist())) == want
    floor = -want[-1][0]
    [(_, slots, scores)] = ms.search_block([(0, list(lists), floor)], lists, pairs, 200, 10)
    assert list(zip((-scores).tolist(), slots.tolist())) == want


def test_pairs_tighten_bounds():
    """Two terms that never meet count once."""
    assert ms.prefix_bounds([5, 7], lambda i, j: 0) == [0, 5, 7]
    assert ms.prefix_bounds([5, 7, 6, 2], lambda i, j: 8 if j - i == 2 else 99)[-1] == 16


def test_skipping_reads_fewer_lists():
    """With tightened bounds fewer documents become candidates than with the sums of maxima."""
    lists = {t: (np.arange(t * 50, t * 50 + 50, dtype=np.int32), np.full(50, 100 + t)) for t in range(4)}
    plain, tight = ms.prefix_bounds([100, 101, 102, 103], lambda i, j: 10 ** 6), ms.prefix_bounds([100, 101, 102, 103], lambda i, j: 0)
    assert tight[-1] == 101 + 103 and plain[-1] > tight[-1]
    [(_, slots, _)] = ms.search_block([(0, [0, 1, 2, 3], 0)], lists, {}, 200, 10)
    assert slots.tolist() == list(range(150, 160))
