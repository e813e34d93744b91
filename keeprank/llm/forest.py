"""Near-duplicate texts by a MinHash LSH forest: prefixes of signature labels give candidates, whole shingle sets verify them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.llm.lattice import cut, slices
from keeprank.llm.storage import settle
from keeprank.llm.tiles import linked_groups

WORDS = 5
THRESHOLD = 0.8
TREES = 40
LONGEST_PREFIX = 10
TARGET_RECALL = 0.99999
BLOCK_ROWS = 256
COLUMNS = 8_192
SEED = 20
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit hashes."""
    h = h.copy()
    for factor in MIX:
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def prefix_depth(threshold: float, trees: int = TREES, longest: int = LONGEST_PREFIX, target: float = TARGET_RECALL) -> int:
    """Shorten the matched prefix from the longest on until a pair at ``threshold`` is found with probability ``target``."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``words`` words (A-Z in lower case, cut at ASCII white space). A shorter
    text is one run; a text without words has none."""
    import xxhash

    codes, distinct, bounds = cut(texts)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))[codes]
    n = len(own)
    rolled = np.zeros(n, dtype=np.uint64)
    power = 1
    for j in range(words):
        rolled[:n - j] += own[j:] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in own[a:b]:
                short = mixed(np.array([(int(short) * 31 + int(h)) & (2 ** 64 - 1)], dtype=np.uint64))[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


class Forest:
    """Keys of the signature prefixes: a label per tree and level is the smallest value of a hash family over the shingles."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(SEED)
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(1, 2 ** 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2 ** 63, trees * depth, dtype=np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        labels = np.full(len(self.factors), 2 ** 64 - 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(shingles), 2_048):
                part = shingles[lo:lo + 2_048, None]
                labels = np.minimum(labels, (part * self.factors + self.offsets).min(axis=0))
            key = np.arange(self.trees, dtype=np.uint64) + np.uint64(1)
            for level in labels.reshape(self.trees, self.depth).T:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + level)
        return key.view(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix. Shingles that one set alone has are left out."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    rank = np.cumsum(count > 1) - 1
    column = rank[column]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(rank[-1]) + 1 if len(rank) else 0
    edges = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            part = np.zeros((n, min(COLUMNS, width - i * COLUMNS)), dtype=np.float32)
            part[row[a:b], column[a:b] - i * COLUMNS] = 1.0
            out += part @ part.T
    return out


def verified(key: int, cross: bool, blocks: np.ndarray, sets: list[np.ndarray], kept: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of one tile that are similar enough and that no bucket with a smaller key also holds."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    inter = overlaps(sets).astype(np.float64)
    linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        linked &= blocks[:, None] != blocks[None, :]
    smaller = [k[k < key] for k in kept]
    if linked.any() and sum(map(len, smaller)):
        row = np.repeat(np.arange(n), [len(k) for k in smaller])
        names, column = np.unique(np.concatenate(smaller), return_inverse=True)
        for lo in range(0, len(names), COLUMNS):
            here = (column >= lo) & (column < lo + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(names) - lo)), dtype=np.float32)
            part[row[here], column[here] - lo] = 1.0
            linked &= (part @ part.T) < 0.5
    return linked


def tile_result(ids: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """(id, n, to): per class the number of documents linked in this tile, and an edge to the smallest id connected here."""
    counts = (linked @ copies.astype(np.float64)).astype(np.int64)
    label, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        seen = np.minimum(label, np.where(linked, label[None, :], far).min(axis=1, initial=far))
        if (seen == label).all():
            break
        label = seen
    hit = counts > 0
    return pd.DataFrame({"id": ids[hit], "n": counts[hit], "to": label[hit]})


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES,
                    target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept) for every row of ``docs``.

    Two documents link if the Jaccard similarity of their sets of ``words``-word runs is at least ``threshold``; candidates are found
    with a probability of at least ``target``, and each is verified on the whole sets. Documents with equal sets form a class, named by its smallest doc_id. ``n_links``
    counts the other documents linked directly, those of the class included; ``component_id`` is the smallest doc_id reachable by links; ``kept`` is true for
    the document of that id. Null and empty texts link with nothing. Texts of fewer words are one run. Rows that repeat an id and a text
    count as copies and share the decision. A null id comes back with its links; it is kept only if no id in its group is not null.
    No rows give none; columns other than ``doc_id`` and ``text`` are ignored.

    A class appears in the bucket of its prefix in each tree. Buckets with the same members are used once, and a pair in
    the bucket of its smallest key only. Buckets are cut by hash into blocks, and a task verifies one pair of blocks and returns
    counts and edges to one member, never the pairs.
    """
    depth = prefix_depth(threshold, trees, LONGEST_PREFIX, target)
    forest = Forest(trees, depth)

    def sign(batches):
        import xxhash

        for batch in batches:
            for piece in slices(batch, 1):
                cols: tuple[list, ...] = ([], [], [])
                for shingles in shingle_sets(piece.column(1), words):
                    cols[0].append(xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2 ** 63 if len(shingles) else None)
                    cols[1].append(len(shingles))
                    cols[2].append(forest.keys(shingles) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.list_(pa.int64()))], ["doc_id", "digest", "cid", "size", "keys"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    signed = settle(rows.mapInArrow(sign, "doc_id long, digest long, cid long, size int, keys array<long>"), "signatures")
    classes = settle(signed.filter("cid IS NOT NULL").groupBy("cid").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("rep"), F.first("keys").alias("keys")).select(
        "cid", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"), "keys"), "classes")

    placed = classes.select("cid", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(
        F.xxhash64(F.lit(1), "cid")).alias("y")).filter("n > 1")
    used = settle(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")),
                  "buckets")
    members = placed.join(used, "key").groupBy("cid").agg(F.collect_list(F.struct("key", "blocks")).alias("in"))
    wanted = classes.select("cid", "copies", "rep_id", "rep_digest").join(members, "cid")
    bodies = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.rep_id) & (rows.digest == wanted.rep_digest)).select(
        "cid", "copies", F.transform("in", lambda s: s["key"]).alias("kept"), "text", F.explode("in").alias("at"))
    block = F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("at.blocks")).cast("int")
    tiles = bodies.select("cid", "copies", "kept", "text", F.col("at.key").alias("key"), block.alias("block"), F.explode(
        F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "copies", "kept", "text")

    def verify(batches):
        held: list[tuple] = []
        current = None

        def flush():
            if len(held) < 2:
                return None
            first = {h[1]: h for h in held}  # a repeated row of one document
            own = list(first.values())
            sets = shingle_sets(pa.array([h[4] for h in own], pa.string()), words)
            linked = verified(current[0], current[1] != current[2], np.array([h[0] for h in own]), sets,
                              [np.array(h[3], dtype=np.int64) for h in own], threshold)
            return tile_result(np.array([h[1] for h in own], dtype=np.int64), np.array([h[2] for h in own]), linked)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            names = list(zip(*(c.to_pylist() for c in columns[:3])))
            for i, name in enumerate(names):
                if name != current:
                    done = flush()
                    if done is not None and len(done):
                        yield pa.RecordBatch.from_pandas(done, preserve_index=False)
                    held, current = [], name
                held.append((columns[3][i].as_py(), columns[4][i].as_py(), columns[5][i].as_py(), columns[6][i].values.to_numpy(), columns[7][i].as_py()))
        done = flush()
        if done is not None and len(done):
            yield pa.RecordBatch.from_pandas(done, preserve_index=False)

    found = settle(tiles.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(
        verify, "id long, n long, to long"), "links")
    groups = linked_groups(found)
    per_class = settle(classes.select("cid", "copies", "rep_id").join(groups, F.col("cid") == F.col("id"), "left").select(
        "cid", "copies", "rep_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cid").alias("component")), "class-links")
    heads = per_class.groupBy("component").agg(F.min("rep_id").alias("head"))
    named = per_class.join(heads, "component").select("cid", (F.col("n") + F.col("copies") - 1).alias("links"), "rep_id", "head")
    return signed.select("doc_id", "cid").join(named, "cid", "left").select(
        "doc_id", F.coalesce("rep_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("head", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("head", "doc_id")).alias("kept"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` doesn't keep; columns as they are, rows without an id stay."""
    gone = near_duplicates(docs, **options).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")).distinct()
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return wide.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
