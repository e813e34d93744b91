"""Exact top-k by inner product: tiled matrix products, a partial selection per tile, merged in two levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keeprank.llm.vectors import dealt, finite, stack

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
TILE_ROWS = 2_048
FEWEST_SHARDS = 24
SAFE = 2.0 ** 52


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2**52, else in whole numbers."""
    bound = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1]
    if bound < SAFE:
        return q @ x.T
    exact = np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array(
        [[int(v) for v in row] for row in x], dtype=object).T
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the ``k`` columns of highest score, ties to the smaller column."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype != object and np.abs(scores).max(initial=0.0) * n < SAFE:
        keys = scores * n - np.arange(n)
        part = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(-keys, part, axis=1).argsort(axis=1)
        return np.take_along_axis(part, order, axis=1)
    return np.stack([sorted(range(n), key=lambda j: (-row[j], j))[:k] for row in scores]).reshape(len(scores), k)


def search_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The best candidates of one tile for each of its queries; a query never meets its own id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    out = []
    for i in range(0, len(q_ids), TILE_ROWS):
        qi, qm = q_ids[i:i + TILE_ROWS], q[i:i + TILE_ROWS]
        for j in range(0, len(c_ids), TILE_ROWS):
            ci, s = c_ids[j:j + TILE_ROWS], products(qm, c[j:j + TILE_ROWS])
            # A row with the query's own id may be among the best, so one more place per such row is kept.
            own = int(np.unique(ci, return_counts=True)[1].max(initial=1))
            at = best_columns(s, k + own)
            rows = np.repeat(np.arange(len(qi)), at.shape[1])
            cols = at.reshape(-1)
            keep = qi[rows] != ci[cols]
            rows, cols = rows[keep], cols[keep]
            out.append(pd.DataFrame({"query_id": qi[rows], "vec_id": ci[cols], "score": s[rows, cols].astype("int64")}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its ``k`` best rows by integer inner product.

    ``is_query`` is a condition over the columns of ``vectors``. Components become floor(scale * x).
    Rows with a null id, or a vector that is null, empty, or holds null or non-finite components, take no
    part. Vectors of different lengths are not compared. Rows that share an id are separate candidates, and
    a query id given several times is answered once, by its smallest vector. Ties go to the smaller id.
    Fewer than ``k`` candidates: all of them. An empty table, or one without queries, gives no rows.
    Scores outside 64 bits saturate. Other columns are ignored.

    Candidates and queries are dealt by hash into shards of bounded size; one task multiplies one block of
    queries with one shard and keeps its best ``k``, so neither side is ever gathered whole.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(-(-sizes["n"] // SHARD_ROWS), min(FEWEST_SHARDS, -(-sizes["n"] // 512)), 1)
    blocks = max(-(-sizes["q"] // QUERY_ROWS), 1)

    candidates = rows.select(F.col("vec_id").alias("cand_id"), F.col("v").alias("cand"), dealt("vec_id", shards).alias("shard"),
                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                           dealt("vec_id", blocks, 1).cast("int").alias("block"))

    def tile(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [search_tile(np.empty(0, "int64"), np.zeros((0, 1)), np.empty(0, "int64"), np.zeros((0, 1)), k)]
        q_len, c_len = q["v"].map(len), c["cand"].map(len)
        for width in sorted(set(q_len) & set(c_len)):
            qs, cs = q[q_len == width], c[c_len == width]
            found.append(search_tile(qs["vec_id"].to_numpy(), stack(qs["v"]), cs["cand_id"].to_numpy(), stack(cs["cand"]), k))
        return pd.concat(found).assign(shard=int(key[0]))

    tops = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInPandas(
        tile, "query_id long, vec_id long, score long, shard long")
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    merged = tops.withColumn("branch", F.expr("shard div 32")).withColumn(
        "place", F.row_number().over(best("query_id", "branch"))).filter(F.col("place") <= k)
    return merged.withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
