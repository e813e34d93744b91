"""Subword lattice likelihood: the scores of a unigram vocabulary weight all segmentations of a text."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keeprank.llm.bpe import fresh, tokenizer_path
from keeprank.llm.pieces import NORMAL, read_model
from keeprank.llm.storage import settle

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
ROUNDS = 2
FLOOR = 0.5
COMMON_WORDS = 200_000
HELD_WORDS = 400_000
SLICE_BYTES = 12_000_000
GROUP_CELLS = 400_000
BASE = 1_000_003


def log_sum(parts: np.ndarray) -> np.ndarray:
    """log(sum(exp)) over the first axis; all parts at minus infinity give minus infinity."""
    top = parts.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(parts - safe).sum(axis=0)) + safe


@dataclass
class Lattice:
    """A unigram vocabulary with natural-log scores. ``units``: pieces first, then the 256 bytes."""

    pieces: list[str]
    scores: np.ndarray

    def __post_init__(self):
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append((self.hash_of([ord(c) for c in p]), i))
        self.tables = {}
        for n, own in by_length.items():
            own.sort()
            self.tables[n] = (np.array([h for h, _ in own], dtype=np.uint64), np.array([i for _, i in own], dtype=np.int64))
        self.longest = max(by_length, default=1)

    @staticmethod
    def hash_of(points: list[int]) -> int:
        h = 0
        for p in points:
            h = (h * BASE + p) & (2 ** 64 - 1)
        return h

    def arcs(self, points: np.ndarray) -> dict[int, np.ndarray]:
        """Per arc length the unit of every window, -1 where there is none. ``points``: code points, a row per word."""
        m, n = points.shape
        prefix = np.zeros((m, n + 1), dtype=np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + points[:, j]
        out, power = {}, 1
        for size in range(1, min(n, self.longest) + 1):
            power = power * BASE & (2 ** 64 - 1)
            if size not in self.tables:
                continue
            keys, units = self.tables[size]
            window = prefix[:, size:] - prefix[:, :n - size + 1] * np.uint64(power)
            at = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
            out[size] = np.where(keys[at] == window, units[at], -1)
        return out

    def fallback(self, points: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of every character without a piece, those characters' bytes as counts per distinct character)."""
        lost = np.unique(points[single < 0]) if (single < 0).any() else np.zeros(0, points.dtype)
        spelled = np.zeros((len(lost), 256))
        for i, p in enumerate(lost):
            for b in chr(int(p)).encode("utf-8", "surrogatepass"):
                spelled[i, b] += 1
        return lost, spelled

    def forward(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log of the marginal probability of each word with the mark before it, expected unit counts under ``weights``)."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.scores)) if weights is not None else None
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-2))
        for a, b in zip(edges[:-1], edges[1:]):
            n = int(size[order[a]])
            step = max(1, GROUP_CELLS // (n * min(n, self.longest)))
            for lo in range(a, b, step):
                own = order[lo:min(b, lo + step)]
                text = "".join(MARK + words[i] for i in own)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n).astype(np.uint64)
                out[own] = self.run(points, expected, weights[own] if weights is not None else None)
        return out, expected

    def run(self, points: np.ndarray, expected: np.ndarray | None, weights: np.ndarray | None) -> np.ndarray:
        m, n = points.shape
        arcs = self.arcs(points)
        arcs.setdefault(1, np.full((m, n), -1, dtype=np.int64))
        with_none = np.append(self.scores, -np.inf)
        score = {k: with_none[u] for k, u in arcs.items()}
        lost, spelled = self.fallback(points, arcs[1])
        if len(lost):
            gone = arcs[1] < 0
            at = np.searchsorted(lost, points[gone])
            score[1][gone] = (spelled @ self.scores[len(self.pieces):])[at]
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            alpha[j] = log_sum(np.stack([alpha[j - k] + s[:, j - k] for k, s in score.items() if k <= j]))
        if expected is None:
            return alpha[n]
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0.0
        for j in range(n - 1, -1, -1):
            beta[j] = log_sum(np.stack([beta[j + k] + s[:, j] for k, s in score.items() if j + k <= n]))
        for k, s in score.items():
            hit = np.exp(alpha[:n - k + 1].T + s + beta[k:].T - alpha[n][:, None]) * weights[:, None]
            found = arcs[k] >= 0
            expected += np.bincount(arcs[k][found], weights=hit[found], minlength=len(expected))
            if k == 1 and len(lost):
                sums = np.bincount(at, weights=hit[gone], minlength=len(lost))
                expected[len(self.pieces):] += sums @ spelled
        return alpha[n]


def existing_vocabulary(path: str | None = None) -> Lattice:
    """The pieces of a public model with scores from its ranking (in proportion to 1 / rank), bytes last."""
    model = read_model(path or tokenizer_path(VOCABULARY))
    pieces = list(dict.fromkeys(p for p, _, kind in model.pieces if kind == NORMAL and p.strip(MARK) or p == MARK))
    rank = np.concatenate([np.arange(len(pieces)) + 10.0, np.full(256, len(pieces) + 10.0)])
    return Lattice(pieces, np.log(1 / rank) - np.log((1 / rank).sum()))


def cut(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of every token, distinct tokens, offsets of the texts): A-Z in lower case, cut at ASCII white space; null is empty."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(fresh(texts)))
    bounds = words.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = words.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in distinct:
        full = codes != distinct.index("")
        counted = np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
        return codes[full], distinct, counted[bounds]
    return codes, distinct, bounds


def slices(batch: pa.RecordBatch, column: int):
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    edges = np.flatnonzero(np.diff(size, prepend=-1, append=-2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)


def count_words(docs: DataFrame, learns: Column) -> DataFrame:
    """(word, trained, seen): occurrences in the rows to learn from and in all rows; the row without a word counts ends of texts."""

    def count(batches):
        sums: dict[str | None, list[int]] = {}

        def rows():
            words = list(sums)
            both = np.array(list(sums.values()), dtype=np.int64).reshape(-1, 2)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                              ["word", "trained", "seen"])

        for batch in batches:
            for piece in slices(batch, 0):
                codes, distinct, bounds = cut(piece.column(0))
                learn = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                seen = np.bincount(codes, minlength=len(distinct))
                trained = np.bincount(codes[np.repeat(learn, np.diff(bounds))], minlength=len(distinct))
                distinct.append(None)
                for w, t, s in zip(distinct, [*trained.tolist(), int(learn.sum())], [*seen.tolist(), len(learn)]):
                    if s:
                        own = sums.get(w)
                        if own is None:
                            sums[w] = [t, s]
                        else:
                            own[0] += t
                            own[1] += s
                if len(sums) > HELD_WORDS:
                    yield rows()
        yield rows()

    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns")).mapInArrow(
        count, "word string, trained long, seen long").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def fit_scores(words: DataFrame, start: Lattice, rounds: int = ROUNDS) -> Lattice:
    """Scores of the vocabulary by expectation-maximisation over the distinct trained words of ``words(word, trained)``.
    The expected counts of a round are one row per unit and task, a number that the vocabulary bounds."""
    lattice = start
    for _ in range(rounds):
        current = lattice

        def expect(batches, current=current):
            total = np.zeros(len(current.scores))
            for pdf in batches:
                total += current.forward(pdf["word"].tolist(), np.ones(len(pdf)))[1]
            at = np.flatnonzero(total)
            yield pd.DataFrame({"unit": at, "n": total[at]})

        sums = words.filter("word IS NOT NULL AND trained > 0").select("word").mapInPandas(
            expect, "unit int, n double").groupBy("unit").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(len(current.scores), FLOOR)
        counts[sums["unit"].to_numpy(dtype=np.int64)] += sums["n"].to_numpy()
        lattice = Lattice(current.pieces, np.log(counts) - math.log(counts.sum()))
    return lattice


@dataclass
class WordModel:
    """Probability of a word: an arc over the whole word for words of the training rows, whose count is discounted, beside all
    ways through the pieces, which share what the discount leaves."""

    lattice: Lattice
    total: int
    types: int
    discount: float
    end: float  # probability that a text ends here

    def log10_score(self, words: list[str], trained: np.ndarray) -> np.ndarray:
        starts = [i for i, p in enumerate(self.lattice.pieces) if p.startswith(MARK)]
        # A word lasts until the next piece with a mark, so dividing by the share of such pieces makes words sum to one.
        pieces = self.lattice.forward(words)[0] - np.log(np.exp(self.lattice.scores[starts]).sum())
        share = self.discount * self.types / self.total if self.total else 1.0
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(trained - self.discount, 0.0) / max(self.total, 1))
        return (np.logaddexp(own, math.log(share) + pieces) + math.log1p(-self.end)) / math.log(10.0)


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the most frequent words: all whose count reaches a limit, which a histogram of counts by their
    logarithm (a few thousand rows at any size) gives. Whole steps of the histogram are taken, none where the first has too many."""
    step = F.floor(F.log2(F.col("seen")) * 16).cast("int")
    total, limit = 0, None
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += row["n"]
        if total > most:
            break
        limit = row["step"]
    return words.filter(step >= limit if limit is not None else F.lit(False))


def lattice_scores(docs: DataFrame, learns: Column, vocabulary: Lattice | None = None, common: int = COMMON_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the whole text: the product over its words of the sum over all ways to cut the word,
    with the mark of a word start before it, into pieces of the vocabulary (characters outside it into bytes) or one arc over the
    whole word if the training rows hold it, times the end's. Words run between ASCII white space, A-Z in lower case. As no piece holds a word start after its first place, the marginal of a text is the
    product of its words' marginals, so each distinct word of the corpus is scored once by the forward recursion. ``base_score`` is the
    word unigram with half-count smoothing. Rows where ``learns`` is null or false are not learned from.
    Null and empty texts are one end. Rows that repeat an id are scored each. No rows give none.

    The scores of at most ``common`` most frequent words go to every task; all other words
    are joined by a shuffle, where each is rare.
    """
    counted = settle(count_words(docs, learns), "words")
    totals = counted.agg(F.sum("trained").alias("n"), F.count_if(F.expr("trained > 0")).alias("v"),
                         F.sum(F.when(F.col("word").isNull(), F.col("trained"))).alias("ends"),
                         F.count_if(F.expr("trained = 1 AND word IS NOT NULL")).alias("once"),
                         F.count_if(F.expr("trained = 2 AND word IS NOT NULL")).alias("twice")).first()
    n, v, ends = totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0
    discount = (totals["once"] + 0.5) / (totals["once"] + 2 * totals["twice"] + 1.0)
    model = WordModel(fit_scores(counted, vocabulary or existing_vocabulary()), n - ends, v - int(ends > 0), discount,
                      (ends + 0.5) / (n + 1.0))
    bottom = math.log10(n + 0.5 * (v + 1))

    def weigh(batches):
        for pdf in batches:
            yield pdf.assign(lat=model.log10_score(pdf["word"].tolist(), pdf["trained"].to_numpy(dtype=np.float64)))

    words = settle(counted.filter("word IS NOT NULL").mapInPandas(
        weigh, "word string, trained long, seen long, lat double"), "word-scores")
    top = most_frequent(words, common).toPandas()
    places = {w: i for i, w in enumerate(top["word"])}
    # One row more for words that are not among the common ones: they add nothing here.
    known = np.append(top["trained"].to_numpy(dtype=np.int64) > 0, False)
    base = np.append(np.log10(top["trained"].to_numpy(dtype=np.float64) + 0.5), 0.0)
    lat = np.append(top["lat"].to_numpy(dtype=np.float64), 0.0)

    def look_up(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, 1):
                codes, distinct, bounds = cut(piece.column(1))
                at = np.fromiter(map(places.get, distinct, itertools.repeat(len(places))), np.int64, len(distinct))[codes]
                tokens = np.diff(bounds)
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(x[at], dtype=np.longdouble)])[bounds]).astype(np.float64)
                        for x in (known, base, lat)]
                rare = at == len(places)
                marks = np.concatenate([np.zeros(1, np.int64), np.cumsum(rare)])[bounds]
                others = pa.array(distinct, pa.string()).take(pa.array(codes[rare]))
                count = len(tokens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + count)), piece.column(0), piece.column(2), pa.array(tokens), pa.array(sums[0].astype(np.int64)),
                    pa.array(sums[1]), pa.array(sums[2]),
                    pa.ListArray.from_arrays(pa.array(marks.astype(np.int32)), others)],
                    ["row", "doc_id", "learned", "tokens", "known", "base", "lat", "rare"])
                row += count

    looked = settle(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learned")).mapInArrow(
        look_up, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, learned boolean, tokens long, known long,"
                 " base double, lat double, rare array<string>"), "looked-up")
    rest = looked.select("row", F.explode("rare").alias("word")).join(words, "word").groupBy("row").agg(
        F.count_if(F.expr("trained > 0")).alias("more_known"), F.sum(F.log10(F.col("trained") + 0.5)).alias("more_base"), F.sum("lat").alias("more_lat"))
    more = lambda c: F.coalesce(c, F.lit(0))
    tokens = F.col("tokens") + 1
    return looked.drop("rare").join(rest, "row", "left").select(
        "doc_id", "learned", tokens.alias("n_tokens"),
        (F.col("known") + more("more_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") + F.lit(math.log10(ends + 0.5)) - tokens * F.lit(bottom)).alias("base_score"),
        (F.col("lat") + more("more_lat") + F.lit(math.log10(model.end))).alias("score"))
