"""User × item matrix, biases and factor models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keeprank.functions.arrays import dot
from keeprank.functions.scoring import freshness_weight
from keeprank.operators.ranking import dense_index
from keeprank.session import write_and_read


def interaction_matrix(interactions: DataFrame, now: Column | None = None) -> DataFrame:
    """Σ rating·weight per (user, item); decayed weight when ``now`` is given, stored weight otherwise."""
    weight = freshness_weight(F.col("ts"), now) if now is not None else F.col("weight")
    return interactions.groupBy("user_id", "item_id").agg(F.sum(F.col("rating") * weight).alias("value"))


def matrix_bias(matrix: DataFrame) -> DataFrame:
    """Global mean over stored entries; user and item bias = mean over all cells minus the global mean."""
    n_users = matrix.select("user_id").distinct().agg(F.count("*").alias("n")).scalar()
    n_items = matrix.select("item_id").distinct().agg(F.count("*").alias("n")).scalar()
    mean = matrix.agg(F.avg("value").alias("m")).scalar()
    users = matrix.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("s")).select(
        F.lit("user").alias("kind"), "id", (F.col("s") / n_items - mean).alias("bias"))
    items = matrix.groupBy(F.col("item_id").alias("id")).agg(F.sum("value").alias("s")).select(
        F.lit("item").alias("kind"), "id", (F.col("s") / n_users - mean).alias("bias"))
    return users.unionByName(items)


def cf_predict(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, bias: DataFrame,
               global_mean: Column) -> DataFrame:
    """global + user bias + item bias + dot; an unknown user or item gives the global mean."""
    u = user_factors.join(bias.filter("kind = 'user'").select(F.col("id").alias("user_id"), F.col("bias").alias("user_bias")), "user_id")
    i = item_factors.join(bias.filter("kind = 'item'").select(F.col("id").alias("item_id"), F.col("bias").alias("item_bias")), "item_id")
    joined = pairs.join(u, "user_id", "left").join(i, "item_id", "left")
    full = global_mean + F.col("user_bias") + F.col("item_bias") + dot(F.col("user_factor"), F.col("item_factor"))
    return joined.withColumn("prediction", F.coalesce(full, global_mean))


def als_factors(matrix: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 42):
    """Implicit-feedback ALS model. Ids are mapped to dense integers first, so any id type and size works."""
    from pyspark.ml.recommendation import ALS

    users = dense_index(matrix.select("user_id").distinct(), "user_id", "u")
    items = dense_index(matrix.select("item_id").distinct(), "item_id", "i")
    indexed = matrix.join(users, "user_id").join(items, "item_id").select(
        F.col("u").cast("int"), F.col("i").cast("int"), "value")
    model = ALS(userCol="u", itemCol="i", ratingCol="value", rank=rank, maxIter=iterations, implicitPrefs=True,
                seed=seed, nonnegative=False).fit(indexed)
    uf = model.userFactors.join(users.withColumn("id", F.col("u").cast("int")), "id").select(
        "user_id", F.col("features").cast("array<double>").alias("user_factor"))
    itf = model.itemFactors.join(items.withColumn("id", F.col("i").cast("int")), "id").select(
        "item_id", F.col("features").cast("array<double>").alias("item_factor"))
    return uf, itf


SALT_CELLS = 100_000
OVERSAMPLE = 8
BRANCH = 32


def _sums(cells: DataFrame, block: DataFrame, by: str, over: str, width: int) -> DataFrame:
    """``by`` rows of the product of the matrix with ``block(over, x)``: one join, one sum per column with map-side combine."""
    joined = cells.join(block, [over, f"{over}_salt"])
    sums = joined.groupBy(by).agg(*[F.sum(F.col("value") * F.get("x", F.lit(j))).alias(f"c{j}") for j in range(width)])
    return sums.select(by, F.array(*[F.col(f"c{j}") for j in range(width)]).alias("x"))


def tree_qr(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of a tall table of rows ``x``: one factor per partition, merged in ``BRANCH`` branches, so only
    ``width`` x ``width`` matrices ever meet, and one of them per branch reaches the driver."""
    def factor(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack([np.zeros((width, width)), *blocks]), mode="r")

    def leaf(batches):
        from pyspark import TaskContext

        r = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                r = factor([r, np.stack([np.asarray(v, dtype=np.float64) for v in batch["x"]])])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.reshape(-1).tolist()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = factor([np.asarray(v).reshape(width, width) for v in pdf["r"]])
        return pd.DataFrame({"r": [r.reshape(-1).tolist()]})

    level = rows.select("x").mapInPandas(leaf, "part int, r array<double>")
    branches = level.groupBy((F.col("part") % BRANCH).alias("branch")).applyInPandas(merge, "r array<double>")
    return factor([np.asarray(r["r"]).reshape(width, width) for r in branches.collect()])


def _times(rows: DataFrame, key: str, m: np.ndarray, name: str) -> DataFrame:
    """Rows ``x`` times a small matrix."""
    def product(batches):
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in batch["x"]])
                yield pd.DataFrame({key: batch[key], name: list(x @ m)})

    return rows.select(key, "x").mapInPandas(product, f"{key} {rows.schema[key].dataType.simpleString()}, {name} array<double>")


def _orthonormal(rows: DataFrame, key: str, width: int) -> DataFrame:
    """The same space with orthonormal columns; directions that the rows do not have become zero columns."""
    _, sizes, right = np.linalg.svd(tree_qr(rows, width))
    inverse = np.where(sizes > 1e-12 * max(sizes[0], 1e-300), 1 / np.maximum(sizes, 1e-300), 0.0)
    return _times(rows, key, right.T * inverse, "x")


def svd_factors(matrix: DataFrame, k: int, rounds: int = 4):
    """Truncated SVD by randomised block power iteration: user = U·Σ, item = V, both with ``k`` columns.

    The block has ``k`` + ``OVERSAMPLE`` columns and starts from hashes of the item ids. Each half round is a join of the cells with the
    block and a grouped sum; columns are made orthonormal by a tree of QR factors over the partitions, so only matrices as wide as the
    block come to the driver, whatever the numbers of users and items. Users and items with many cells are salted. Each
    block is a table in the shared folder, so a lost executor costs one step. ``k`` is cut to the number of users and items.
    """
    cells = write_and_read(matrix.select("user_id", "item_id", "value"), "svd-cells")
    salts = {}
    for side, other in (("user_id", "item_id"), ("item_id", "user_id")):
        counted = cells.groupBy(side).agg(F.ceil(F.count("*") / SALT_CELLS).cast("int").alias("salts"))
        salts[side] = write_and_read(counted, f"svd-{side}")
    n_users, n_items = (salts[side].count() for side in ("user_id", "item_id"))
    k = max(1, min(k, n_users, n_items))
    width = min(k + OVERSAMPLE, max(1, min(n_users, n_items)))
    for side, other in (("user_id", "item_id"), ("item_id", "user_id")):
        heavy = salts[side].filter("salts > 1")
        cells = cells.join(heavy, side, "left").withColumn(
            f"{side}_salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    cells = write_and_read(cells, "svd-salted")

    def block(rows: DataFrame, side: str, name: str) -> DataFrame:
        return write_and_read(rows.select(side, "x"), name)

    def salted(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(salts[side], side).select(side, "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(f"{side}_salt"))

    start = [F.xxhash64(F.lit(j), "item_id") / F.lit(float(2 ** 63)) for j in range(width)]
    items = block(salts["item_id"].select("item_id", F.array(*start).alias("x")), "item_id", "svd-start")
    for _ in range(rounds):
        users = block(_sums(cells, salted(items, "item_id"), "user_id", "item_id", width), "user_id", "svd-user-block")
        users = _orthonormal(users, "user_id", width)
        items = block(_sums(cells, salted(users, "user_id"), "item_id", "user_id", width), "item_id", "svd-item-block")
    # The matrix is Q·itemsᵀ now; the small factor of its item side carries the rotation and the singular values.
    _, sizes, right = np.linalg.svd(tree_qr(items, width))
    turn = right.T[:, :k]
    user_factors = _times(users, "user_id", turn * sizes[:k], "user_factor")
    inverse = np.where(sizes[:k] > 1e-12 * max(sizes[0], 1e-300), 1 / np.maximum(sizes[:k], 1e-300), 0.0)
    item_factors = _times(items, "item_id", turn * inverse, "item_factor")
    return user_factors, item_factors


def inbatch_softmax_loss(pairs: DataFrame, batch_size: int, tau: float, key: str = "pair_id") -> DataFrame:
    """Cross-entropy with in-batch negatives: row i's positive is on the diagonal of its batch.

    ``pairs(pair_id, user_vector, item_vector)``. Batches are cut from a dense hash order, so each holds at
    most ``batch_size`` rows; one batch is one matrix product in a task and yields one row.
    """
    indexed = dense_index(pairs.select(key, "user_vector", "item_vector"), key)
    batched = indexed.select(F.floor(F.col("idx") / batch_size).alias("batch"), "user_vector", "item_vector")

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        def unit(col):
            m = np.stack([np.asarray(v, dtype=np.float64) for v in col])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        s = unit(pdf["user_vector"]) @ unit(pdf["item_vector"]).T / tau
        top = s.max(axis=1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "rows": [len(pdf)], "loss": [float((lse - np.diag(s)).mean())]})

    return batched.groupBy("batch").applyInPandas(loss, "batch bigint, rows bigint, loss double")


def link_margin_loss(scored: DataFrame, margin: float = 0.5) -> DataFrame:
    """Mean ranking loss of ``scored(pos_score, neg_score)``."""
    return scored.agg(F.count("*").alias("pairs"), F.avg(
        F.greatest(F.lit(0.0), F.lit(margin) - (F.col("pos_score") - F.col("neg_score")))).alias("loss"))
