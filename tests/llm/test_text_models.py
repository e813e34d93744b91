"""Lattice likelihood against enumeration, and the toxicity classifier on held-out rows."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keeprank.llm import lattice as lt
from keeprank.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, score double, word string, row int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1.0, "w", 7) for i, t in texts], DOCS)


def small_lattice():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "c", "▁abc"]
    weights = np.concatenate([np.arange(1.0, len(pieces) + 1), np.full(256, 0.01)])
    return lt.Lattice(pieces, np.log(weights / weights.sum()))


def enumerate_paths(model, word):
    """All ways through ``▁`` + word, as (log probability, units)."""
    text, units = lt.MARK + word, {p: i for i, p in enumerate(model.pieces)}

    def walk(at):
        if at == len(text):
            return [(0.0, [])]
        out = []
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in units:
                out += [(model.scores[units[text[at:end]]] + s, [units[text[at:end]], *u]) for s, u in walk(end)]
        if text[at] not in units:
            own = [len(model.pieces) + b for b in text[at].encode()]
            out += [(model.scores[own].sum() + s, own + u) for s, u in walk(at + 1)]
        return out

    return walk(0)


def test_forward_sums_all_segmentations():
    model = small_lattice()
    words = ["a", "ab", "abab", "babab", "abcab", "é", "aéb", "x😀", "c" * 30, "ab"]
    weights = np.arange(1.0, len(words) + 1)
    got, expected = model.forward(words, weights)
    want = np.zeros(len(model.scores))
    for w, g, k in zip(words, got, weights):
        paths = enumerate_paths(model, w)
        total = sum(math.exp(s) for s, _ in paths)
        assert math.isclose(g, math.log(total), rel_tol=1e-9)
        for s, units in paths:
            for u in units:
                want[u] += k * math.exp(s) / total
    assert np.allclose(expected, want)


def test_word_probabilities_stay_below_one():
    model = lt.WordModel(small_lattice(), 100, 10, 0.6, 0.05)
    scores = model.log10_score(["ab", "abc", "zz"], np.array([5.0, 0.0, 0.0]))
    assert (scores < 0).all() and scores[0] > scores[2]


def naive_base(texts, learned):
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if learned[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
            for i, ws in tokens.items()}


@pytest.mark.parametrize("common", [3, 10_000])
def test_document_scores(spark, common, monkeypatch):
    monkeypatch.setattr(lt, "HELD_WORDS", 4)
    texts = [(0, "The cat  sat\ton\x0bthe mat."), (1, "the CAT ran"), (2, ""), (3, None), (4, "unseen wörds here 𠮷"), (5, " lead and trail "),
             (6, "the " * 3000), (7, "x" * 3000), (8, "ÀÉ à\u0085b")]
    learned = {i: i not in (1, 4) for i, _ in texts}
    got = {r["doc_id"]: r for r in lt.lattice_scores(docs_of(spark, texts), ~F.col("doc_id").isin(1, 4), common=common).collect()}
    for i, (n, known, total, base) in naive_base(texts, learned).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (n, known, total, learned[i])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert got[2]["score"] == got[3]["score"] > got[1]["score"] > got[4]["score"]


def test_no_documents_and_no_learning(spark):
    assert lt.lattice_scores(docs_of(spark, []), F.lit(True)).count() == 0
    rows = lt.lattice_scores(docs_of(spark, [(1, "some words"), (1, "some words"), (None, "no id")]), F.lit(None).cast("boolean")).collect()
    assert len(rows) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_lattice_beats_a_uniform_guess_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    row = lt.lattice_scores(docs, ~held).filter("NOT learned").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert row["s"] / row["n"] > -7


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = tx.toxicity_scores(docs, labels)
    pairs = scored.join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").select("score", "toxic", "rejected").toPandas()
    good, bad = pairs[pairs.toxic == 0].score.to_numpy(), pairs[pairs.toxic == 1].score.to_numpy()
    auc = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert len(bad) > 50 and auc > 0.97
    assert (pairs.rejected == (pairs.toxic == 1)).mean() > 0.97


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (90, None)], "doc_id long, toxic int")
    texts = [(i, "fine words only" if i % 2 == 0 else "you awful thing") for i in range(40)] + [(50, None), (51, ""), (52, "!!"), (None, "awful"),
                                                                                               (53, "fine " * 30_000 + "awful"), (53, "")]
    docs = docs_of(spark, texts)
    rows = tx.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (50, 51, 52)}
    assert len(blank) == 1
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(texts)
    none = tx.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(texts) and {r["score"] for r in none} == {0.5}
    assert tx.toxicity_scores(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_slices():
    texts = ["one two", "", "three bad words here", None, "x"] * 20
    model = tx.fit(["good words"] * 30 + ["bad words"] * 30, np.array([0] * 30 + [1] * 30, np.float32), epochs=1)
    whole = model.score(pa.array(texts))
    assert np.allclose(whole, np.concatenate([model.score(pa.array(texts).slice(i, 7)) for i in range(0, 100, 7)]))


def test_thresholds():
    assert 0.4 < tx.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) < 0.8


def test_all_labelled_texts_are_learned_from(spark, monkeypatch):
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 0 and zlib.crc32(b"calibrate%d" % i) % 4 != 0
    bad = lambda i: i % 3 == 0
    texts = [(i, f"plain word{i % 7} {'awful thing' if bad(i) else 'fine day'}" + " more" * (9_000 if i % 50 == 0 else 1)) for i in range(7_000)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(bad(i))) for i, _ in texts], "doc_id long, toxic int")
    table = tx.sums_of_parts(docs, tx.marks_of(labels), 3).toArrow().to_pandas().set_index("key")
    rows, marked = (sum(learn(i) for i, _ in texts), sum(learn(i) for i, _ in texts if bad(i)))
    assert tuple(table.loc[table.index.max(), ["texts", "marked"]]) == (rows, marked) and rows > 4_000
    assert tuple(table.loc[zlib.crc32(b"more") % tx.BUCKETS, ["texts", "marked"]]) == (rows, marked)
    monkeypatch.setattr(tx, "RUN_ROWS", 700)
    made = [tx.train(d, labels, part_rows=2_000) for d in (docs, docs.repartition(5))]
    assert np.array_equal(made[0].embedding, made[1].embedding) and np.array_equal(made[0].weights, made[1].weights)
    assert made[0].thresholds == made[1].thresholds and {"", "en"} == set(made[0].thresholds)
    high, low = made[0].score(pa.array(["plain awful thing", "plain fine day"]))
    assert high > 0.9 and low < 0.1


def test_binned_thresholds(spark):
    rng = np.random.default_rng(3)
    scores = np.round(rng.random(400), 4)
    toxic = (scores + rng.normal(0, 0.2, 400) > 0.5).astype(int)
    rows = [("a" if i % 3 else None, float(s), int(t)) for i, (s, t) in enumerate(zip(scores, toxic))]
    got = tx.thresholds_of(spark.createDataFrame(rows, "lang string, score double, toxic int"))
    own = np.array([r[0] == "a" for r in rows])
    assert abs(got[""] - tx.best_threshold(scores, toxic)) < 2e-3 and abs(got["a"] - tx.best_threshold(scores[own], toxic[own])) < 2e-3
