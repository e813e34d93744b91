"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one kept per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.llm.tiles import linked_groups, star_edges
from keeprank.llm.vectors import dealt, finite, stack
from keeprank.session import write_and_read

SAMPLE_ROWS = 20_000
MOST_CELLS = 4_096
CELL_ROWS = 8_192
BLOCK_ROWS = 1_024
LOOK_ROWS = 4_096
VISIT_CELLS = 2_000_000


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling by the largest component first keeps extreme values finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; deterministic, empty cells are dropped."""
    k = max(1, min(k, len(x)))
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1)
        centers = sums[length > 1e-9] / length[length > 1e-9, None]
    return centers


def visits(x: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, boolean matrix of cells to look into) for unit rows.

    A vector of another cell within distance ``reach`` lies behind the plane halfway between the two
    centroids, so a cell whose plane is farther than that cannot hold a partner.
    """
    sims = x @ centers.T
    home = sims.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centers @ centers.T), 0) + 1e-12)[home]
    away = sims[np.arange(len(x)), home][:, None] - sims
    return home, away <= reach * gap + 1e-9


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cells: int | None = None, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows link if their labels are equal and not null and the cosine, in double precision, is at least
    ``threshold`` (above 0). Rows whose vector is null, empty, zero or holds null or non-finite components, and rows
    without a label, link with nothing and stand alone. Rows with a null id come back with no links, a null
    component and kept. Repeated rows of one id count as one vector (the smallest). Vectors of different
    lengths never link. An empty table gives no rows; other columns are ignored.

    Cells come from spherical k-means on at most ``SAMPLE_ROWS`` vectors, chosen by hash. A vector is compared
    with the vectors of its own cell and of every cell within ``reach``, the greatest distance that a linked
    pair can have, so no link is lost; a smaller ``reach`` trades recall for work. Cells are cut by hash into blocks of about
    ``BLOCK_ROWS``, and a task returns counts and a spanning star per block pair, never pairs. Vectors that are
    equal are compared once and counted with their number.
    """
    spark = vectors.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7 if reach is None else reach
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("v"))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))
                         & F.exists("v", lambda x: x != 0.0))
    once = usable.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    members = write_and_read(once, "near-members")
    classes = members.groupBy("label", "v").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"))
    classes = write_and_read(classes, "near-classes")
    total = classes.count()
    k = cells or max(1, min(MOST_CELLS, total // CELL_ROWS))
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = classes.filter(F.pmod(F.xxhash64(F.lit(5), "rep_id"), 1_000_000) < int(share * 1_000_000)).select(
        F.size("v").alias("width"), "v").limit(2 * SAMPLE_ROWS).toPandas()
    centers = {int(w): spherical_kmeans(unit(stack(g["v"])), k) for w, g in sample.groupby("width")}

    def place(batches):
        for batch in batches:
            out = []
            for width, g in batch.groupby(batch["v"].map(len)):
                c = centers.get(int(width))
                if c is None:
                    c = np.ones((1, int(width))) / math.sqrt(int(width))
                step = max(1, VISIT_CELLS // len(c))
                for some in (g.iloc[lo:lo + step] for lo in range(0, len(g), step)):
                    home, look = visits(unit(stack(some["v"])), c, reach)
                    r, cell = np.nonzero(look)
                    out.append(pd.DataFrame({"rep_id": some["rep_id"].to_numpy()[r], "label": some["label"].to_numpy()[r],
                                             "width": int(width), "cell": cell, "home": home[r] == cell}))
            if out:
                yield pd.concat(out)

    places = classes.select("rep_id", "label", "v").mapInPandas(
        place, "rep_id long, label string, width int, cell int, home boolean")
    places = write_and_read(places, "near-places")
    key = ["label", "width", "cell"]
    sizes = places.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("lookers"))
    sized = sizes.select(*key, F.ceil(F.col("homes") / BLOCK_ROWS).cast("int").alias("home_blocks"),
                         F.ceil(F.col("lookers") / LOOK_ROWS).cast("int").alias("look_blocks")).filter("home_blocks > 0")
    vector = classes.select("rep_id", "v", "copies")
    both = places.join(sized, key).join(vector, "rep_id")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lookers = both.select(*key, "rep_id", "v", F.lit(0).alias("copies"), F.lit(False).alias("home"),
                          dealt("rep_id", F.col("look_blocks"), 1).cast("int").alias("look_block"),
                          spread("home_blocks").alias("home_block"))
    homes = both.filter("home").select(*key, "rep_id", "v", "copies", "home", spread("look_blocks").alias("look_block"),
                                       dealt("rep_id", F.col("home_blocks"), 2).cast("int").alias("home_block"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        h, q = pdf[pdf["home"]], pdf[~pdf["home"]]
        if not len(h) or not len(q):
            return pd.DataFrame({"id": [], "n": [], "to": []}).astype("int64")
        hi, qi, copies = h["rep_id"].to_numpy(), q["rep_id"].to_numpy(), h["copies"].to_numpy()
        linked = unit(stack(q["v"])) @ unit(stack(h["v"])).T >= threshold
        linked |= qi[:, None] == hi[None, :]
        return star_edges(qi, hi, linked, copies)

    found = lookers.unionByName(homes).groupBy(*key, "look_block", "home_block").applyInPandas(
        tile, "id long, n long, to long")
    found = write_and_read(found, "near-found")
    groups = linked_groups(found)
    per_class = classes.select("label", "v", "rep_id").join(groups, F.col("rep_id") == F.col("id"), "left")
    owned = members.join(per_class.withColumnRenamed("label", "l").withColumnRenamed("v", "w"),
                         (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left").select(
        "vec_id", (F.col("n") - 1).alias("links"), F.coalesce("component", "rep_id").alias("component"))
    return rows.select("vec_id").join(owned, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept")).withColumn(
        "kept", F.coalesce("kept", F.lit(True)))
