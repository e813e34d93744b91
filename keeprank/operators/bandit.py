"""LinUCB statistics, solves and arm rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank import settings as S
from keeprank.operators.ranking import top_k


def linucb_fit(pulls: DataFrame, dim: int = len(S.BANDIT_FEATURES)) -> DataFrame:
    """A = I + Σxxᵀ (row-major) and b = Σ r·x per arm, from ``pulls(arm_id, x, reward)``.

    Both are plain sums: one partial-aggregated row per arm, whatever the arm's share of the log.
    """
    x = [F.get("x", F.lit(i)) for i in range(dim)]
    sums = [F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(dim) for j in range(i, dim)]
    sums += [F.sum(x[i] * F.col("reward")).alias(f"b_{i}") for i in range(dim)]
    grouped = pulls.groupBy("arm_id").agg(*sums, F.count("*").alias("pulls"), F.sum("reward").alias("total_reward"))
    a = [F.col(f"a_{min(i, j)}_{max(i, j)}") + F.lit(1.0 if i == j else 0.0) for i in range(dim) for j in range(dim)]
    return grouped.select("arm_id", "pulls", "total_reward", F.array(*a).alias("A"),
                          F.array(*[F.col(f"b_{i}") for i in range(dim)]).alias("b"))


def linucb_solve(stats: DataFrame) -> DataFrame:
    """θ = A⁻¹b and A⁻¹ per arm, solved in batches of small matrices."""

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.stack([np.asarray(v) for v in pdf["b"]])
            d = b.shape[1]
            inv = np.linalg.inv(np.stack([np.asarray(v) for v in pdf["A"]]).reshape(-1, d, d))
            theta = np.einsum("nij,nj->ni", inv, b)
            yield pd.DataFrame({"arm_id": pdf["arm_id"], "theta": list(theta), "inverse": list(inv.reshape(len(b), -1))})

    kind = stats.schema["arm_id"].dataType.simpleString()
    return stats.select("arm_id", "A", "b").mapInPandas(solve, f"arm_id {kind}, theta array<double>, inverse array<double>")


def top_arms(contexts: DataFrame, arms: DataFrame, k: int, alpha: float = S.BANDIT_ALPHA, allowed: DataFrame | None = None,
             block_rows: int = 20_000) -> DataFrame:
    """k best arms per distinct context by xᵀθ + α·sqrt(xᵀA⁻¹x): (x, arm_id, ucb, rank).

    ``contexts`` may repeat vectors; each distinct vector is scored once. Context blocks meet arm blocks of
    bounded size, each pairing returns at most k arms per context. ``allowed(arm_id)`` restricts the arms.
    """
    if allowed is not None:
        arms = arms.join(allowed, "arm_id", "left_semi")
    distinct = contexts.select("x").distinct()
    c_blocks = max(1, -(-distinct.count() // block_rows))
    a_blocks = max(1, -(-arms.count() // block_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = distinct.select("x", F.pmod(F.xxhash64("x"), F.lit(c_blocks)).alias("cb"), spread(a_blocks).alias("ab"))
    right = arms.select("arm_id", "theta", "inverse", F.pmod(F.xxhash64("arm_id"), F.lit(a_blocks)).alias("ab"),
                        spread(c_blocks).alias("cb"))

    def score(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(a):
            return pd.DataFrame({"x": [], "arm_id": [], "ucb": []}, dtype=object)
        a = a.sort_values("arm_id", kind="stable")
        theta = np.stack([np.asarray(v) for v in a["theta"]])
        inv = np.stack([np.asarray(v) for v in a["inverse"]]).reshape(len(a), theta.shape[1], -1)
        ids, frames = a["arm_id"].to_numpy(), []
        for lo in range(0, len(c), 256):
            x = np.stack([np.asarray(v) for v in c["x"].iloc[lo:lo + 256]])
            spread_ = np.einsum("ci,nij,cj->cn", x, inv, x, optimize=True)
            ucb = np.round(x @ theta.T + alpha * np.sqrt(np.maximum(spread_, 0.0)), 9)
            best = np.argsort(-ucb, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(x)), best.shape[1])
            frames.append(pd.DataFrame({"x": list(x[rows]), "arm_id": ids[best.ravel()], "ucb": ucb[rows, best.ravel()]}))
        return pd.concat(frames)

    kind = arms.schema["arm_id"].dataType.simpleString()
    found = left.groupBy("cb", "ab").cogroup(right.groupBy("cb", "ab")).applyInPandas(
        score, f"x array<double>, arm_id {kind}, ucb double")
    return top_k(found, ["x"], [F.desc("ucb"), F.asc("arm_id")], k)
