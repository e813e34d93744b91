"""Counting links block by block: each tile returns sums and a spanning star, never its pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.operators.graph import connected_components


def star_edges(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """(id, n, to): per row id the weighted number of linked columns, and for every id an edge to the smallest
    id that it is connected with inside this tile. There are as many result rows as ids, whatever the number of links."""
    counts = linked @ weights.astype(np.float64)
    far = np.iinfo("int64").max
    row_label, col_label = rows.astype("int64").copy(), cols.astype("int64").copy()
    while True:
        seen_r = np.minimum(row_label, np.where(linked, col_label[None, :], far).min(axis=1, initial=far))
        seen_c = np.minimum(col_label, np.where(linked, seen_r[:, None], far).min(axis=0, initial=far))
        if (seen_r == row_label).all() and (seen_c == col_label).all():
            break
        row_label, col_label = seen_r, seen_c
    out = pd.concat([pd.DataFrame({"id": rows, "n": counts.astype("int64"), "to": row_label}),
                     pd.DataFrame({"id": cols, "n": 0, "to": col_label})])
    return out[(out["n"] > 0) | (out["to"] != out["id"])]


def linked_groups(found: DataFrame) -> DataFrame:
    """(id, n, component): sums of ``found(id, n, to)`` and the smallest id that each id is connected with."""
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.filter("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()
    component = connected_components(edges)
    return sums.join(component, sums.id == component.node, "left").select(
        "id", "n", F.coalesce("component", "id").alias("component"))
