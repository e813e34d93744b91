"""Toxicity: a convolutional text classifier on hashed word embeddings, trained on every labelled row, with a threshold per language."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keeprank.llm.bpe import fresh

BUCKETS = 1 << 16
WIDTH = 16
FILTERS = 8
SPANS = (1, 2, 3)
STEM_CHARS = 4
PART_ROWS = 8_192
RUN_ROWS, RUN_CHARS = 8_192, 16_000_000
BINS = 10_000
ONE = 1 << 24
EPOCHS = 2
BATCH = 64
FEWEST_FOR_THRESHOLD = 25
THRESHOLD_RANGE = (0.25, 0.75)
SLICE_BYTES = 2_000_000
SEED = 11


def cut_words(texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """(code of every word, distinct words, offsets of the texts). Words are runs of letters and digits, lower case; null is empty."""
    lowered = pc.utf8_lower(fresh(texts))
    words = pc.split_pattern_regex(lowered, r"[^\p{L}\p{N}]+")
    bounds = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    bounds = bounds - bounds[0]
    full = np.fromiter((w != "" for w in distinct), bool, len(distinct))[codes] if len(codes) else np.zeros(0, bool)
    counted = np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
    return codes[full], distinct, counted[bounds]


def buckets_of(words: list, buckets: int) -> np.ndarray:
    """Two buckets a word: of the word and of its first letters; rows of a distinct word, columns as said."""
    out = np.empty((len(words), 2), dtype=np.int64)
    for i, w in enumerate(words):
        out[i, 0] = zlib.crc32(w.encode()) % buckets
        out[i, 1] = zlib.crc32(b"^" + w[:STEM_CHARS].encode()) % buckets
    return out


def padded(codes: np.ndarray, bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with more pads after every text than the widest span; (codes, first position, end) with at least one position a text."""
    n = np.diff(bounds)
    pads = max(SPANS) + 1
    shift = np.arange(len(n)) * pads
    out = np.full(len(codes) + len(n) * pads, pad, dtype=np.int64)
    out[np.arange(len(codes)) + np.repeat(shift, n)] = codes
    first = bounds[:-1] + shift
    return out, first, first + np.maximum(n, 1)


@dataclass
class Classifier:
    """Embeddings, filters per span, output weights; ``thresholds`` by language, ``""`` for all others."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # span -> (span, WIDTH, FILTERS)
    offsets: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    def features(self, words: np.ndarray, codes: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Highest answer of each filter in each text, before the rectifier. ``words``: an embedding per distinct word, the last one is the pad."""
        edges = np.stack([first, end], axis=1).reshape(-1)
        out = []
        for span in SPANS:
            each = [(words @ self.filters[span][j]).astype(np.float32) for j in range(span)]
            n = len(codes) - span + 1
            sums = each[0][codes[:n]]
            for j in range(1, span):
                sums += each[j][codes[j:j + n]]
            out.append(np.maximum.reduceat(sums, edges, axis=0)[::2] + self.offsets[span])
        return np.hstack(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, distinct, bounds = cut_words(texts)
        at = buckets_of(distinct, len(self.embedding))
        words = np.vstack([self.embedding[at[:, 0]] + self.embedding[at[:, 1]], np.zeros((1, self.embedding.shape[1]), np.float32)])
        codes, first, end = padded(codes, bounds, len(distinct))
        return sigmoid(np.maximum(self.features(words, codes, first, end), 0) @ self.weights + self.bias)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x.astype(np.float64), -35, 35)))


def log_odds(toxic: np.ndarray, every: np.ndarray, base: float) -> np.ndarray:
    """Start of the first embedding coordinate: the clipped log-odds of a bucket that ``every`` texts hold, ``toxic`` of them marked."""
    odds = np.log((toxic + 2 * base) / (every - toxic + 2 * (1 - base) + 1e-9) * (1 - base + 1e-3) / base)
    return np.where(every > 0, 0.5 * np.clip(odds, -2, 4), 0).astype(np.float32)


class Learner:
    """Adam on the log loss over runs of whole texts, with the counts that start the embeddings. Equal texts in equal order give equal weights."""

    def __init__(self, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.emb = (self.rng.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32)
        params = {f"f{s}": (self.rng.standard_normal((s, WIDTH, FILTERS)) * 0.2).astype(np.float32) for s in SPANS}
        params["w"] = (np.abs(self.rng.standard_normal(FILTERS * len(SPANS))) * 0.3).astype(np.float32)
        params["b"] = np.array([-2.0], np.float32)
        for s in SPANS:
            params[f"f{s}"][:, 0, :] = np.abs(params[f"f{s}"][:, 0, :]) + (0.5 / s)
            params[f"o{s}"] = np.zeros(FILTERS, np.float32) - 1.0
        self.params = params
        self.first_m, self.second_m = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        self.emb_m, self.emb_v = np.zeros_like(self.emb), np.zeros_like(self.emb)
        self.counts = np.zeros((BUCKETS, 2, 2), dtype=np.int64)  # bucket, column of ``buckets_of``, (texts, marked texts)
        self.moved = np.zeros_like(self.emb)
        self.rows, self.marked, self.step = 0, 0.0, 0

    def run(self, texts: list, labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Count the buckets of these texts and pass over them ``epochs`` times."""
        codes, distinct, bounds = cut_words(pa.array(texts, pa.string()))
        codes, at = codes.astype(np.int32), buckets_of(distinct, BUCKETS)
        before = self.odds()
        for i, label in enumerate(labels):
            for column in range(2):
                own = np.unique(at[codes[bounds[i]:bounds[i + 1]], column])
                self.counts[own, column, 0] += 1
                self.counts[own, column, 1] += int(label)
        self.rows, self.marked = self.rows + len(labels), self.marked + float(labels.sum())
        self.emb[:, 0] += self.odds() - before
        start = self.emb.copy()
        self.descend(codes, at, len(distinct), bounds, labels, epochs)
        self.moved += self.emb - start

    def odds(self) -> np.ndarray:
        base = max(self.marked / self.rows, 1e-3) if self.rows else 0.5
        return sum(log_odds(self.counts[:, c, 1], self.counts[:, c, 0], base) for c in range(2))

    def descend(self, codes, at, pad_code: int, bounds, labels, epochs: int) -> None:
        emb, params, first_m, second_m, emb_m, emb_v = self.emb, self.params, self.first_m, self.second_m, self.emb_m, self.emb_v
        weights, rate = params["w"], 0.01
        for _ in range(epochs):
            order = self.rng.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                rows = order[lo:lo + BATCH]
                self.step += 1
                step = self.step
                own = [codes[bounds[r]:bounds[r + 1]] for r in rows]
                local = np.concatenate([[0], np.cumsum([len(c) for c in own])])
                flat, first, end = padded(np.concatenate(own), local, pad_code)
                uniq, back = np.unique(flat, return_inverse=True)
                pad = uniq == pad_code
                bucket = at[np.where(pad, 0, uniq)] if len(at) else np.zeros((len(uniq), 2), int)
                words = emb[bucket[:, 0]] + emb[bucket[:, 1]]
                words[pad] = 0
                top, where = [], []
                for s in SPANS:
                    n = len(flat) - s + 1
                    x = sum((words @ params[f"f{s}"][j])[back[j:j + n]] for j in range(s))
                    best = np.stack([first[i] + x[first[i]:end[i]].argmax(axis=0) for i in range(len(rows))])
                    where.append(best)
                    top.append(np.take_along_axis(x, best, axis=0) + params[f"o{s}"])
                raw = np.hstack(top)
                active = np.maximum(raw, 0)
                error = (sigmoid(active @ weights + params["b"][0]) - labels[rows]).astype(np.float32) / len(rows)
                grads = {"w": active.T @ error, "b": np.array([error.sum()], np.float32)}
                down = error[:, None] * weights[None, :] * (raw > 0)
                word_grad = np.zeros_like(words)
                for k, s in enumerate(SPANS):
                    g = down[:, k * FILTERS:(k + 1) * FILTERS]
                    grads[f"o{s}"] = g.sum(axis=0)
                    gf = np.zeros_like(params[f"f{s}"])
                    for j in range(s):
                        at_word = back[where[k] + j]
                        gf[j] = np.einsum("df,dfe->ef", g, words[at_word])
                        np.add.at(word_grad, at_word, g[:, :, None] * params[f"f{s}"][j].T[None])
                    grads[f"f{s}"] = gf
                word_grad[pad] = 0
                touched, slot = np.unique(bucket.reshape(-1), return_inverse=True)
                ge = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(ge, slot, np.repeat(word_grad, 2, axis=0))
                fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
                for key, g in grads.items():
                    first_m[key] = 0.9 * first_m[key] + 0.1 * g
                    second_m[key] = 0.999 * second_m[key] + 0.001 * g * g
                    params[key] -= rate * (first_m[key] / fix1) / (np.sqrt(second_m[key] / fix2) + 1e-8)
                emb_m[touched] = 0.9 * emb_m[touched] + 0.1 * ge
                emb_v[touched] = 0.999 * emb_v[touched] + 0.001 * ge * ge
                emb[touched] -= rate * (emb_m[touched] / fix1) / (np.sqrt(emb_v[touched] / fix2) + 1e-8)
            rate *= 0.7


def model_of(emb: np.ndarray, params: dict) -> Classifier:
    return Classifier(emb, {s: params[f"f{s}"] for s in SPANS}, {s: params[f"o{s}"] for s in SPANS}, params["w"], float(params["b"][0]))


def constant(marked: float, rows: int) -> Classifier:
    """Where only one label is known, or none: the same score for every text."""
    learner = Learner()
    learner.params["w"] = np.zeros_like(learner.params["w"])
    learner.params["b"] = np.array([np.log((marked + 0.5) / (rows - marked + 0.5)) if rows else 0.0])
    return model_of(learner.emb, learner.params)


def fit(texts: list, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Classifier:
    """Train on whole texts by Adam on the log loss. One embedding coordinate starts as the log-odds of its bucket."""
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.sum()), len(labels))
    learner = Learner(seed)
    learner.run(texts, labels, epochs)
    return model_of(learner.emb, learner.params)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the range of thresholds with the highest F1, kept within ``THRESHOLD_RANGE``."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    below = s[s < s[i]]
    return float(np.clip((s[i] + (below[0] if len(below) else 0.0)) / 2, *THRESHOLD_RANGE))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def calibrates(doc_id: Column) -> Column:
    """A quarter of the ids: their rows choose the thresholds and are not learned from."""
    return F.crc32(F.concat(F.lit("calibrate"), doc_id.cast("string")).cast("binary")) % 4 == 0


def usable(rows: DataFrame) -> DataFrame:
    """Held-out rows and null ids take no part in learning."""
    return rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def texts_of(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))


def marks_of(labels: DataFrame) -> DataFrame:
    return usable(labels).filter(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def sums_of_parts(docs: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """(key, weight, texts, marked, texts2, marked2, v0 …): what the learners of all parts add up to, in whole numbers, so in any order.

    A part holds the ids of one hash value with their labels and whole texts, in order of the id, and learns from all of them in runs of bounded
    bytes. Keys below ``BUCKETS`` are embeddings: how often texts hold the bucket, and its movement times that; then follow the other
    parameters times the rows, ``WIDTH`` a row; the last one has the rows and the marked ones.
    """
    names = [f"v{i}" for i in range(WIDTH)]
    schema = "key int, weight bigint, texts bigint, marked bigint, texts2 bigint, marked2 bigint, " + ", ".join(f"{n} bigint" for n in names)

    def learn(batches):
        learner, texts, labels, size, current, label = Learner(), [], [], 0, None, 0
        for batch in batches:
            ids, marks, bodies = (batch.column(k) for k in range(3))
            for i, (key, mark) in enumerate(zip(ids.to_pylist(), marks.to_pylist())):
                if mark is not None:
                    label = max(label, mark) if key == current else mark
                    current = key
                elif key == current:
                    texts.append(bodies[i].as_py())
                    labels.append(label)
                    size += len(texts[-1])
                    if size >= RUN_CHARS or len(texts) >= RUN_ROWS:
                        learner.run(texts, np.array(labels, np.float32))
                        texts, labels, size = [], [], 0
        if texts:
            learner.run(texts, np.array(labels, np.float32))
        if learner.rows:
            yield packed(learner)

    def packed(learner):
        held = np.flatnonzero(learner.counts.any(axis=(1, 2)))
        weight = learner.counts[held, :, 0].sum(axis=1)
        dense = np.concatenate([learner.params[k].reshape(-1) for k in sorted(learner.params)]).astype(np.float64)
        dense = np.concatenate([dense, np.zeros(-len(dense) % WIDTH)]).reshape(-1, WIDTH)
        values = np.vstack([learner.moved[held].astype(np.float64) * weight[:, None], dense * learner.rows, np.zeros((1, WIDTH))])
        own = learner.counts[held].reshape(-1, 4)
        rest = np.zeros((len(dense) + 1, 4), np.int64)
        rest[-1, :2] = learner.rows, int(learner.marked)
        counts = np.vstack([own, rest])
        keys = np.concatenate([held, BUCKETS + np.arange(len(dense) + 1)]).astype(np.int32)
        weights = np.concatenate([weight, np.full(len(dense), learner.rows), [0]]).astype(np.int64)
        whole = np.rint(values * ONE).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weights), *[pa.array(counts[:, k].copy()) for k in range(4)],
                                           *[pa.array(whole[:, k].copy()) for k in range(WIDTH)]],
                                          names=["key", "weight", "texts", "marked", "texts2", "marked2", *names])

    key = F.col("doc_id").cast("string").alias("key")
    known = marks.select(key, "toxic", F.lit(None).cast("string").alias("text"))
    bodies = usable(texts_of(docs)).filter(~calibrates(F.col("doc_id"))).select(key, F.lit(None).cast("int").alias("toxic"), "text")
    dealt = known.filter(~calibrates(F.col("key"))).union(bodies).repartition(parts, "key")
    ordered = dealt.sortWithinPartitions("key", F.col("toxic").asc_nulls_last(), F.xxhash64("text"))
    made = ordered.mapInArrow(learn, schema)
    return made.groupBy("key").agg(*[F.sum(c).alias(c) for c in made.columns[1:]])


def merged(table: pa.Table) -> Classifier:
    """One model of the sums: embeddings start at the log-odds over all rows and move by the mean of the parts, weighted by the texts
    that hold the bucket; the other parameters are means weighted by rows."""
    at = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(at["key"])
    at = {c: v[order] for c, v in at.items()}
    if not len(order):
        return constant(0.0, 0)
    rows, marked = int(at["texts"][-1]), int(at["marked"][-1])
    if marked in (0, rows):
        return constant(float(marked), rows)
    values = np.stack([at[f"v{i}"] for i in range(WIDTH)], axis=1) / ONE / np.maximum(at["weight"], 1)[:, None]
    emb, dense = at["key"] < BUCKETS, at["key"] >= BUCKETS
    learner = Learner()
    held, base = at["key"][emb], max(marked / rows, 1e-3)
    start = learner.emb.astype(np.float64)
    start[held] += values[emb]
    start[held, 0] += log_odds(at["marked"][emb], at["texts"][emb], base) + log_odds(at["marked2"][emb], at["texts2"][emb], base)
    flat, taken = values[dense][:-1].reshape(-1).astype(np.float32), 0
    for k in sorted(learner.params):
        v = learner.params[k]
        learner.params[k] = flat[taken:taken + v.size].reshape(v.shape)
        taken += v.size
    return model_of(start.astype(np.float32), learner.params)


def thresholds_of(scored: DataFrame) -> dict[str, float]:
    """The threshold with the highest F1 by language and, as ``""``, of all rows ``scored(lang, score, toxic)``, where both labels have
    ``FEWEST_FOR_THRESHOLD`` rows. Rows are counted in ``BINS`` bins of the score; a threshold is the middle between two scores."""
    # Every row counts for its language and for all; null languages are left with the common threshold.
    dealt = scored.select(F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))).alias("lang"), "score", "toxic")
    each = dealt.groupBy("lang", F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high"))
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    every = Window.partitionBy("lang")
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(every))
    cut = (F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2
    best = each.select("lang", "bin", "n", "hits", f1.alias("f1"), cut.alias("cut")).groupBy("lang").agg(
        F.max_by("cut", F.struct("f1", "bin")).alias("cut"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    found = best.filter(F.least(F.col("hits"), F.col("n") - F.col("hits")) >= FEWEST_FOR_THRESHOLD).collect()
    return {r["lang"]: float(np.clip(r["cut"], *THRESHOLD_RANGE)) for r in found}


def train(docs: DataFrame, labels: DataFrame, part_rows: int | None = None) -> Classifier:
    """Learn from every labelled row that is not held out, and choose the thresholds on a quarter of the ids, kept apart: one half where
    they have fewer than ``FEWEST_FOR_THRESHOLD`` rows of either label. Where an id has both labels, 1 holds. Without labelled rows
    every score is one half and nothing is rejected. Parts of about ``part_rows`` labels learn each in a task, from the same
    start, and are averaged; only sums of a fixed size come to the driver. The same tables give the same model."""
    marks = marks_of(labels)
    parts = max(1, -(-marks.count() // (part_rows or PART_ROWS)))
    model = merged(sums_of_parts(docs, marks, parts).toArrow())
    if model.weights.any():
        rest = score_texts(usable(texts_of(docs)).filter(calibrates(F.col("doc_id"))), model).select("doc_id", "lang", "score")
        known = marks.filter(calibrates(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        model.thresholds |= thresholds_of(rest.join(known, "doc_id").select("lang", "score", "toxic"))
    return model


def score_texts(docs: DataFrame, model: Classifier, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of every whole text in ``out``; a column of that name is replaced.
    Null and empty texts get the score of a text without words; repeated rows get equal scores; no rows give none."""
    kept = docs.drop(out)
    place = kept.columns.index(text_col)

    def score(batches):
        for batch in batches:
            texts = batch.column(place)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
            edges = np.flatnonzero(np.diff(size, prepend=-1, append=-2))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.score(piece.column(place)), pa.float64())],
                                                 [*piece.schema.names, out])

    return kept.mapInArrow(score, StructType([*kept.schema.fields, StructField(out, DoubleType())]))


def rejected(model: Classifier, lang: Column, score: Column) -> Column:
    """Whether a score reaches the threshold of its language, or the common one where the language has none."""
    if not model.weights.any():
        return F.lit(False)
    limit = F.lit(model.thresholds[""])
    for name, t in model.thresholds.items():
        if name:
            limit = F.when(lang == name, F.lit(t)).otherwise(limit)
    return score >= limit


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected) for every row of ``docs``: ``predicted`` by one half, ``rejected`` by the
    threshold of the language. Labels of held-out rows are never used."""
    model = train(docs, labels)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_texts(docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         rejected(model, F.col("lang"), F.col("score")).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they are."""
    model = train(docs, labels)
    name = "score"
    while name in docs.columns:
        name += "_"
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return score_texts(docs, model, out=name).filter(~rejected(model, lang, F.col(name))).drop(name)
