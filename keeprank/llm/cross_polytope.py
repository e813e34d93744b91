"""Approximate nearest neighbours: cross-polytope hashing with pseudo-rotations, multiprobe tables and exact re-ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keeprank.llm.storage import settle
from keeprank.llm.vectors import dealt, finite, stack

TABLES = 8
BUCKET_ROWS = 256
BLOCK_ROWS = 4_096
QUERY_BLOCK = 1_024
SALT_ROWS = 4_096
TUNING_QUERIES = 200
TARGET = 0.95
TOP_AXES = 24
LOOK_CELLS = 4_000_000


def mantissas(m: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that no square overflows or vanishes; cosines stay exactly the same."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = mantissas(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, with sums whose order doesn't depend on the other rows."""
    a, b = mantissas(a), mantissas(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


@dataclass(frozen=True)
class Hashes:
    """``tables`` hashes of ``parts`` signed axes each. Only the last part is cut to ``last`` dimensions, which makes the
    number of buckets of a table, (2 * padded) ** (parts - 1) * 2 * last, follow the size of the table of vectors."""

    width: int
    parts: int
    last: int
    tables: int = TABLES
    seed: int = 11

    @property
    def padded(self) -> int:
        return 1 << max(0, self.width - 1).bit_length()

    @property
    def buckets(self) -> int:
        return (2 * self.padded) ** (self.parts - 1) * 2 * self.last

    def rotated(self, x: np.ndarray):
        """For each table and part the coordinates after three rounds of random signs and a Hadamard transform."""
        full = np.zeros((len(x), self.padded))
        full[:, :self.width] = x
        for table in range(self.tables):
            found = []
            for part in range(self.parts):
                rng = np.random.default_rng([self.seed, self.width, table, part])
                y = full
                for _ in range(3):
                    y = hadamard(y * rng.choice([-1.0, 1.0], self.padded))
                found.append(y[:, :self.last] if part == self.parts - 1 else y)
            yield table, found

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of every row, numbered through all tables."""
        out = np.empty((len(x), self.tables), dtype=np.int64)
        for table, parts in self.rotated(x):
            bucket = np.zeros(len(x), dtype=np.int64)
            for y in parts:
                axis = np.abs(y).argmax(axis=1)
                sign = y[np.arange(len(y)), axis] < 0
                bucket = bucket * (2 * y.shape[1]) + 2 * axis + sign
            out[:, table] = table * self.buckets + bucket
        return out

    def probes(self, x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, order): for every row the buckets of all tables, the likeliest first, at most ``most`` of them.

        The likelihood of an axis falls with the distance of the coordinate to the largest one of its part, so buckets are
        ordered by the sum of squared distances. With several parts only the ``TOP_AXES`` nearest axes of each take part.
        """
        buckets, costs = [], []
        for table, parts in self.rotated(x):
            bucket, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
            for y in parts:
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                gap = (np.abs(y).max(axis=1, keepdims=True) - both) ** 2
                keep = min(gap.shape[1], gap.shape[1] if self.parts == 1 else TOP_AXES)
                axis = np.argsort(gap, axis=1, kind="stable")[:, :keep]
                gap = np.take_along_axis(gap, axis, axis=1)
                bucket = (bucket[:, :, None] * both.shape[1] + axis[:, None, :]).reshape(len(x), -1)
                cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            buckets.append(bucket + table * self.buckets)
            costs.append(cost)
        bucket, cost = np.concatenate(buckets, axis=1), np.concatenate(costs, axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(bucket, order, axis=1), order

    def looks(self) -> int:
        """Buckets in a full probing sequence."""
        axes = [2 * self.last if p == self.parts - 1 else 2 * self.padded for p in range(self.parts)]
        return self.tables * math.prod(axes if self.parts == 1 else [min(a, TOP_AXES) for a in axes])


def candidates_of_width(width: int, rows: int, bucket_rows: int) -> list[Hashes]:
    """The finest hash whose buckets hold about ``bucket_rows`` rows, then coarser ones down to a single signed axis."""
    padded = 1 << max(0, width - 1).bit_length()
    wanted, out = max(1.0, rows / bucket_rows), []
    for parts in (3, 2, 1):
        last = padded
        while last >= 1:
            if (2 * padded) ** (parts - 1) * 2 * last <= 2 * wanted:
                out.append(Hashes(width, parts, last))
            last //= 2
    return out or [Hashes(width, 1, 1)]


def probes_needed(hashes: Hashes, q: np.ndarray, near: np.ndarray, k: int, target: float) -> int | None:
    """The smallest number of probes that finds ``target`` of the pairs (row of ``q``, rows of ``near``), or None."""
    first = []
    step = max(1, LOOK_CELLS // hashes.looks())
    for lo in range(0, len(q), step):
        bucket, _ = hashes.probes(q[lo:lo + step])
        own = hashes.of(near[lo:lo + step].reshape(-1, q.shape[1])).reshape(-1, k, hashes.tables)
        for i in range(len(bucket)):
            rank = pd.Series(np.arange(bucket.shape[1]), index=bucket[i])
            at = rank.reindex(own[i].reshape(-1)).to_numpy(dtype=float).reshape(k, -1)
            first.append(np.where(np.isnan(at), np.inf, at).min(axis=1))
    place = np.sort(np.concatenate(first))[max(0, math.ceil(target * len(first) * k) - 1)]
    return None if math.isinf(place) else int(place) + 1


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best columns of each row, ties to the smaller id."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k] - 1e-12
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[col], -np.round(scores[row, col], 12), row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def in_memory(classes: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Brute force for a bounded set of query classes: blocks of all classes against it, merged per query."""
    q = {int(w): (g["class_id"].to_numpy(), unit(stack(g["v"]))) for w, g in queries.groupby(queries["v"].map(len))}

    def tile(batches):
        for batch in batches:
            for width, g in batch.groupby(batch["v"].map(len)):
                if int(width) not in q:
                    continue
                ids, m = q[int(width)]
                own, v = g["class_id"].to_numpy(), stack(g["v"])
                s = m @ unit(v).T
                s[ids[:, None] == own[None, :]] = -2.0
                r, c = best(s, own, k)
                yield pd.DataFrame({"q": ids[r], "score": s[r, c], "near": own[c], "v": [x.tolist() for x in v[c]]})

    found = classes.select("class_id", "v").mapInPandas(tile, "q long, score double, near long, v array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "near"))
    return found.filter("score > -2").withColumn("place", place).filter(F.col("place") <= k).toPandas()


def tuned(classes: DataFrame, total: int, k: int, target: float, bucket_rows: int) -> dict[int, tuple[Hashes, int]]:
    """For each width the hash and the number of probes that reach ``target`` on a sample of at most ``TUNING_QUERIES`` query classes."""
    widths = {r["width"]: r["n"] for r in classes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    sample = classes.filter("asked > 0").orderBy(F.xxhash64(F.lit(3), "class_id"), "class_id").limit(TUNING_QUERIES).select(
        "class_id", "v").toPandas()
    truth = in_memory(classes, sample, k) if len(sample) else pd.DataFrame({"q": [], "near": [], "v": []})
    out = {}
    for width, rows in widths.items():
        options = candidates_of_width(int(width), rows, bucket_rows)
        asked = sample[sample["v"].map(len) == width]
        near = {i: g for i, g in truth.groupby("q")}
        asked = asked[[len(near.get(i, ())) == k for i in asked["class_id"]]]
        out[int(width)] = (options[-1], options[-1].looks())
        if not len(asked):
            continue
        q = unit(stack(asked["v"]))
        found = unit(stack(pd.concat([near[i].sort_values("near") for i in asked["class_id"]])["v"])).reshape(len(q), k, -1)
        cost = []
        for h in options:
            n = probes_needed(h, q, found, k, target)
            if n is not None:
                cost.append((n / (h.tables * h.buckets), h, n))
        if cost:
            # Rows visited fall with the share of buckets that are opened.
            _, h, n = min(cost, key=lambda c: c[0])
            out[int(width)] = (h, n)
    return out


def nearest(vectors: DataFrame, is_query, k: int = 5, target: float = TARGET, bucket_rows: int = BUCKET_ROWS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every query row, by cosine in double precision.

    ``is_query`` is a condition over the columns of ``vectors``. Rows with a null id, or a vector that is null, empty, zero or holds
    null or non-finite components, take no part. Vectors of different lengths are not compared. Repeated rows of one id
    count as one vector (the smallest). Ties go to the smaller id; fewer than ``k`` candidates: all that are found. An empty table, or one without
    queries, gives no rows. Other columns are ignored.

    Equal vectors are one class, which carries its ``k`` + 1 smallest ids, as no other can be in a result. Every class goes to one bucket in
    each of ``TABLES`` tables; how fine the buckets are follows the number of rows. A query opens as many
    buckets, over all tables and the likeliest first, as find ``target`` of the true neighbours of at most ``TUNING_QUERIES`` queries (chosen by hash),
    which are compared with all rows. Buckets are cut by hash into blocks of bounded size; a task multiplies a block of queries with a
    block of vectors and keeps ``k`` classes of each query, which are ranked by their exact cosines.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col))).filter(F.exists(vector_col, lambda x: x != 0.0)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    once = settle(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "polytope-rows")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = once.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(
        F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = once.groupBy("v").agg(F.count_if("asks").alias("asked")).withColumnRenamed("v", "w")
    classes = settle(few.join(asked, F.col("v") == F.col("w")).drop("w"), "polytope-classes")
    total = classes.count()
    plans = tuned(classes, total, k, target, bucket_rows)

    def hashed(batches):
        for batch in batches:
            for width, g in batch.groupby(batch["v"].map(len)):
                h, _ = plans[int(width)]
                bucket = h.of(unit(stack(g["v"])))
                yield pd.DataFrame({"class_id": np.repeat(g["class_id"].to_numpy(), h.tables), "width": int(width), "bucket": bucket.reshape(-1)})

    def probed(batches):
        for batch in batches:
            for width, g in batch.groupby(batch["v"].map(len)):
                h, most = plans[int(width)]
                step = max(1, LOOK_CELLS // h.looks())
                for some in (g.iloc[lo:lo + step] for lo in range(0, len(g), step)):
                    bucket, _ = h.probes(unit(stack(some["v"])), most)
                    yield pd.DataFrame({"class_id": np.repeat(some["class_id"].to_numpy(), bucket.shape[1]), "width": int(width),
                                        "bucket": bucket.reshape(-1)})

    key, schema = ["width", "bucket"], "class_id long, width int, bucket long"
    index = settle(classes.select("class_id", "v").mapInPandas(hashed, schema), "polytope-index")
    probes = settle(classes.filter("asked > 0").select("class_id", "v").mapInPandas(probed, schema), "polytope-probes")
    sizes = index.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(
        probes.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks")), key)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = index.join(sizes, key).join(classes.select("class_id", "v"), "class_id").select(
        *key, F.col("class_id").alias("cand_id"), F.col("v").alias("cand"),
        dealt("class_id", F.col("blocks"), 1).cast("int").alias("block"), spread("q_blocks").alias("q_block"))
    lookers = probes.join(sizes, key).join(classes.select("class_id", "v"), "class_id").select(
        *key, "class_id", "v", dealt("class_id", F.col("q_blocks"), 2).cast("int").alias("q_block"), spread("blocks").alias("block"))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q": [], "near": [], "score": []}).astype({"q": "int64", "near": "int64", "score": "float64"})
        qi, ci, qv, cv = q["class_id"].to_numpy(), c["cand_id"].to_numpy(), stack(q["v"]), stack(c["cand"])
        r, s = best(unit(qv) @ unit(cv).T, ci, k + 1)
        return pd.DataFrame({"q": qi[r], "near": ci[s], "score": cosines(qv[r], cv[s])})

    at = [*key, "block", "q_block"]
    found = lookers.groupBy(*at).cogroup(members.groupBy(*at)).applyInPandas(tile, "q long, near long, score double")
    # A pair that meets in several tables has one score. A class with k + 1 ids and k + 1 better classes never adds another.
    found = found.groupBy("q", "near").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "near")
    tops = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    tops = tops.join(classes.select(F.col("class_id").alias("near"), "ids"), "near").groupBy("q").agg(
        F.collect_list(F.struct("score", "ids")).alias("tops"))
    salts = F.ceil(F.col("asked") / SALT_ROWS).cast("int")
    tops = tops.join(classes.select(F.col("class_id").alias("q"), "v", salts.alias("salts")), "q").select(
        "v", "tops", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    askers = once.filter("asks").join(classes.filter("asked > 0").select(F.col("v").alias("w"), salts.alias("salts")), F.col("v") == F.col("w"))
    askers = askers.select("vec_id", F.col("v").alias("w"), dealt("vec_id", F.col("salts"), 5).cast("int").alias("s"))
    flat = F.flatten(F.transform("tops", lambda t: F.transform(t["ids"], lambda i: F.struct((-t["score"]).alias("cost"), i.alias("id")))))
    ranked = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("vec_id"))), 1, k)
    out = askers.join(tops, (F.col("v") == F.col("w")) & (F.col("salt") == F.col("s"))).select(
        F.col("vec_id").alias("query_id"), F.posexplode(ranked).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.cost")).alias("score"))
