"""A compressed vector index: inverted lists of product-quantised residuals, searched by products with decoded rows, re-ranked exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.functions.arrays import cosine
from keeprank.functions.hashing import md5_60
from keeprank.operators.ranking import top_k
from keeprank.session import scratch_path, small_table, write_and_read

SAMPLE_ROWS = 40_000
MOST_LISTS = 4_096
PART_DIMS = 4
CODES = 256
BLOCK_ROWS = 16_384
GROUP_ROWS = 131_072
QUERY_ROWS = 4_096
SCORE_CELLS = 1 << 21
TUNING_QUERIES = 200
DIGITS = 9


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1)[None, :] - 2.0 * (x @ centers.T)).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``, deterministic; centres that lose all their rows stay where they were."""
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        home = nearest_center(x, centers)
        counts = np.bincount(home, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


@dataclass
class Codec:
    """Coarse centres (one inverted list each) and, per group of ``PART_DIMS`` dimensions, a codebook of residuals."""

    centers: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Codec:
        x = _unit(sample)
        centers = kmeans(x, lists)
        rest = x - centers[nearest_center(x, centers)]
        return cls(centers, [kmeans(part, CODES) for part in cls.parts(rest)])

    @staticmethod
    def parts(x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, max(1, x.shape[1] // PART_DIMS), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of every row; a code is one byte per part."""
        x = _unit(x)
        home = nearest_center(x, self.centers)
        rest = self.parts(x - self.centers[home])
        return home, np.stack([nearest_center(p, b) for p, b in zip(rest, self.books)], axis=1).astype(np.uint8)

    def lists_of(self, q: np.ndarray) -> np.ndarray:
        """For every query all lists, the nearest first."""
        q = _unit(q)
        return np.argsort((self.centers * self.centers).sum(axis=1)[None, :] - 2.0 * (q @ self.centers.T), axis=1, kind="stable")

    def decode(self, home: int, codes: np.ndarray) -> np.ndarray:
        return self.centers[home] + np.hstack([book[code] for book, code in zip(self.books, codes.T)])

    def scores(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries with the coded rows of one list: a row is decoded once for all queries, then one product."""
        return _unit(q) @ self.decode(home, codes).T


@dataclass
class VectorIndex:
    """``codes(list, block, item_id, code)``, stored by list, the vectors it was built from, and what searching needs."""

    codec: Codec
    codes: DataFrame
    items: DataFrame
    rows: int


def usable(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def lists_for(rows: int) -> int:
    """Lists grow with the square root of the table."""
    return max(1, min(MOST_LISTS, round(2 * math.sqrt(rows))))


def build_index(items: DataFrame, lists: int | None = None, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Index every row of ``items(item_id, embedding)``; vectors that are null, zero or not finite cannot be found.

    Centres and codebooks are fitted on at most ``sample_rows`` vectors, chosen by hash of the id. The codes are written to ``path``,
    one folder per list; a list is cut by hash into blocks of about ``BLOCK_ROWS``, so a list of many equal vectors is spread.
    """
    spark = items.sparkSession
    rows = items.filter(usable(F.col("embedding"))).select("item_id", "embedding")
    n = rows.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    drawn = rows.filter(md5_60(F.col("item_id")) % 1_000_000 < int(share * 1_000_000)).orderBy(md5_60(F.col("item_id"), 1), "item_id")
    sample = drawn.limit(sample_rows).toPandas()
    codec = Codec.fit(_stack(sample["embedding"]) if len(sample) else np.zeros((1, PART_DIMS)), lists or lists_for(n))

    def code(batches):
        for batch in batches:
            if len(batch):
                home, codes = codec.encode(_stack(batch["embedding"]))
                yield pd.DataFrame({"item_id": batch["item_id"], "list": home, "code": [c.tobytes() for c in codes]})

    kind = rows.schema["item_id"].dataType.simpleString()
    coded = write_and_read(rows.mapInPandas(code, f"item_id {kind}, list int, code binary"), "codes-flat")
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = coded.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int"))
    path = path or scratch_path(spark, "vector-index")
    placed.select("list", "block", "item_id", "code").repartition("list", "block").write.mode("overwrite").partitionBy("list").parquet(path)
    return VectorIndex(codec, spark.read.schema(f"block int, item_id {kind}, code binary, list int").parquet(path), rows, n)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row."""
    k = min(k, scores.shape[1])
    col = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), k), col.reshape(-1)


def brute_force(items: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The true ``k`` nearest of a bounded set of queries, all rows in blocks; rows with the query's own vector count."""
    q, ids = _unit(_stack(queries["embedding"])), queries["query_id"].to_numpy()

    def tile(batches):
        for batch in batches:
            if len(batch):
                s = q @ _unit(_stack(batch["embedding"])).T
                r, c = best(s, k)
                yield pd.DataFrame({"q": r, "s": s[r, c], "item_id": batch["item_id"].to_numpy()[c], "v": [v for v in batch["embedding"].to_numpy()[c]]})

    kind = items.schema["item_id"].dataType.simpleString()
    found = top_k(items.mapInPandas(tile, f"q int, s double, item_id {kind}, v array<double>"), ["q"], [F.desc("s"), F.asc("item_id")], k)
    out = found.toPandas()
    return out.assign(query_id=ids[out["q"].to_numpy(dtype=int)]) if len(out) else out


def tune(index: VectorIndex, queries: DataFrame, k: int, recall: float, sample: int = TUNING_QUERIES) -> tuple[int, int]:
    """(lists to open, candidates to re-rank): the fewest that keep ``recall`` of the true neighbours of ``sample`` queries, drawn by hash.

    Half of the allowed loss goes to closed lists, half to the codes' errors.
    """
    asked = queries.orderBy(md5_60(F.col("query_id")), "query_id").limit(sample).toPandas()
    lists = len(index.codec.centers)
    if not len(asked) or not index.rows:
        return lists, k
    truth = brute_force(index.items, asked, k)
    q = _stack(asked["embedding"])
    goal = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / len(truth)))
    home, _ = index.codec.encode(_stack(truth["v"]))
    rank = np.argsort(index.codec.lists_of(q), axis=1)[truth["q"].to_numpy(), home]
    half = (1 + goal) / 2
    probes = int(np.sort(rank)[min(len(rank) - 1, math.ceil(half * len(rank)) - 1)]) + 1
    # Where a true neighbour stands among all approximate scores of the lists that are opened.
    found = places(index, asked, probes, truth)
    place = np.sort(found["place"].to_numpy())
    need = math.ceil(goal * len(truth))
    return probes, max(k, int(place[min(need, len(place)) - 1]) if len(place) else k)


def places(index: VectorIndex, asked: pd.DataFrame, probes: int, truth: pd.DataFrame) -> pd.DataFrame:
    """For a bounded set of queries the place of each true neighbour in the order of approximate scores (counted block by block)."""
    codec, q = index.codec, _stack(asked["embedding"])
    opened = np.zeros((len(q), len(codec.centers)), dtype=bool)
    np.put_along_axis(opened, codec.lists_of(q)[:, :probes], True, axis=1)
    home, codes = codec.encode(_stack(truth["v"]))
    at = truth["q"].to_numpy()
    own = np.array([codec.scores(q[a:a + 1], h, c[None])[0, 0] for a, h, c in zip(at, home, codes)])
    seen = opened[at, home]

    def count(batches):
        above = np.zeros(len(at), dtype=np.int64)
        for batch in batches:
            for h, g in batch.groupby("list"):
                rows = np.flatnonzero(opened[:, h])
                if len(rows):
                    c = np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), -1)
                    s = np.full((len(q), len(g)), -np.inf)
                    s[rows] = codec.scores(q[rows], h, c)
                    s.sort(axis=1)
                    above += np.array([len(g) - np.searchsorted(s[a], o - 1e-12) for a, o in zip(at, own)])
        yield pd.DataFrame({"i": np.arange(len(at)), "n": above})

    counted = index.codes.select("list", "code").mapInPandas(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("place")).toPandas()
    return counted[seen[counted["i"].to_numpy()]]


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int, rerank: int) -> DataFrame:
    """(query_id, item_id, similarity, rank): approximate top ``k`` by cosine for ``queries(query_id, embedding)``.

    Each query opens its ``probes`` nearest lists. Lists are packed into groups of about ``GROUP_ROWS`` codes, and a query travels once to each
    group that holds a list it opens; a task scores a block of queries against the decoded lists of a group and keeps the
    best ``rerank`` of each query over the whole group. The best ``rerank`` over all groups are joined with their vectors and ranked by the exact cosine.
    """
    codec, spark = index.codec, queries.sparkSession
    asked = queries.filter(usable(F.col("embedding"))).select("query_id", "embedding")
    kind = asked.schema["query_id"].dataType.simpleString()
    item_kind = index.items.schema["item_id"].dataType.simpleString()
    sizes = index.codes.groupBy("list", "block").agg(F.count("*").alias("n")).toPandas().sort_values(["list", "block"])
    group = ((sizes["n"].cumsum() - sizes["n"]) // GROUP_ROWS).to_numpy(dtype=np.int64)
    member = np.zeros((len(codec.centers), int(group.max()) + 1 if len(group) else 1))
    member[sizes["list"].to_numpy(dtype=np.int64), group] = 1
    q_blocks = max(1, -(-asked.count() // max(64, min(QUERY_ROWS, SCORE_CELLS // rerank))))

    def opened(q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(codec.centers)), dtype=bool)
        np.put_along_axis(out, codec.lists_of(q)[:, :probes], True, axis=1)
        return out

    def route(batches):
        for batch in batches:
            for lo in range(0, len(batch), QUERY_ROWS):
                some = batch.iloc[lo:lo + QUERY_ROWS]
                row, g = np.nonzero(opened(_stack(some["embedding"])) @ member)
                yield some.iloc[row].assign(g=g.astype(np.int32))

    looks = asked.mapInPandas(route, f"query_id {kind}, embedding {asked.schema['embedding'].dataType.simpleString()}, g int").withColumn(
        "q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
    where = list(zip(sizes["list"].tolist(), sizes["block"].tolist(), group.tolist()))
    schema = "list INT, block INT, l BIGINT"
    groups = small_table(spark, where, schema) if where else spark.createDataFrame([], schema)
    coded = index.codes.join(groups, ["list", "block"]).select(
        F.col("l").cast("int").alias("l"), "list", "item_id", "code",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))).alias("qb"))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"][:0], "item_id": c["item_id"][:0], "near": pd.Series([], dtype=float)})
        vectors, ids = _stack(q["embedding"]), c["item_id"].to_numpy()
        codes, home = np.frombuffer(b"".join(c["code"]), dtype=np.uint8).reshape(len(c), -1), c["list"].to_numpy()
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
        look, held = opened(vectors), min(rerank, len(c))
        near, at = np.full((len(q), held), -np.inf), np.zeros((len(q), held), dtype=np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            own, h = order[a:b], int(home[order[a]])
            rows = np.flatnonzero(look[:, h])
            step = max(1, SCORE_CELLS // (len(own) + held))
            for some in (rows[lo:lo + step] for lo in range(0, len(rows), step)):
                s = np.hstack([near[some], codec.scores(vectors[some], h, codes[own])])
                place = np.hstack([at[some], np.broadcast_to(own, (len(some), len(own)))])
                col = np.argpartition(-s, held - 1, axis=1)[:, :held]
                near[some], at[some] = np.take_along_axis(s, col, axis=1), np.take_along_axis(place, col, axis=1)
        r, i = np.nonzero(near > -np.inf)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[r], "item_id": ids[at[r, i]], "near": near[r, i]})

    found = looks.groupBy("g", "q_block").cogroup(coded.groupBy("l", "qb")).applyInPandas(
        tile, f"query_id {kind}, item_id {item_kind}, near double")
    kept = top_k(found, ["query_id"], [F.desc("near"), F.asc("item_id")], rerank, "place").select("query_id", "item_id")
    exact = kept.join(asked.select("query_id", F.col("embedding").alias("q")), "query_id").join(
        index.items.select("item_id", F.col("embedding").alias("v")), "item_id").select(
        "query_id", "item_id", F.round(cosine(F.col("q"), F.col("v")), DIGITS).alias("similarity"))
    return top_k(exact, ["query_id"], [F.desc("similarity"), F.asc("item_id")], k)


def knn(queries: DataFrame, items: DataFrame, k: int, recall: float = 0.9, lists: int | None = None) -> DataFrame:
    """Build an index over ``items``, choose its settings for ``recall`` on a sample of the queries, and search it."""
    index = build_index(items, lists)
    asked = queries.filter(usable(F.col("embedding"))).select("query_id", "embedding")
    return search_index(index, asked, k, *tune(index, asked, k, recall))
