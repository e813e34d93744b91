"""Ranked lexical search: an index of term and term-pair lists with maximum impacts, searched block by block by MaxScore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank.llm.storage import settle
from keeprank.session import scratch_path

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM_ROWS = 256
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 1_000_000
REACH = 3
UNIT = 1_000_000_000
INDEX = ("item_block long, block long, a long, b long, size long, top long, best array<long>, slots array<int>, impacts array<long>,"
         " doc_ids array<long>")


def terms(text: Column) -> Column:
    """All terms of a text with repeats, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def joint_top(a_slots: np.ndarray, a_impacts: np.ndarray, b_slots: np.ndarray, b_impacts: np.ndarray, k: int) -> tuple[int, int, np.ndarray]:
    """(documents with both terms, largest joint impact, the ``k`` largest joint impacts, descending)."""
    if len(a_slots) > len(b_slots):
        a_slots, a_impacts, b_slots, b_impacts = b_slots, b_impacts, a_slots, a_impacts
    at = np.searchsorted(b_slots, a_slots)
    at[at == len(b_slots)] = 0
    both = b_slots[at] == a_slots if len(b_slots) else np.zeros(len(a_slots), bool)
    joint = a_impacts[both] + b_impacts[at[both]]
    return len(joint), int(joint.max(initial=0)), largest(joint, k)


def largest(values: np.ndarray, k: int) -> np.ndarray:
    if len(values) > k:
        values = np.partition(values, -k)[-k:]
    return np.sort(values)[::-1]


def build_block(item_block: int, block: int, postings: pd.DataFrame, pairs: np.ndarray, k: int) -> pd.DataFrame:
    """The lists of one block of documents: its documents, each term, and each given pair of terms that both occur."""
    docs = postings[["row", "doc_id"]].drop_duplicates("row").sort_values(["doc_id", "row"])
    slot = pd.Series(np.arange(len(docs), dtype=np.int32), index=docs["row"].to_numpy())
    slots = slot.reindex(postings["row"].to_numpy()).to_numpy()
    order = np.lexsort((slots, postings["term_no"].to_numpy()))
    numbers, slots, impacts = postings["term_no"].to_numpy()[order], slots[order], postings["impact"].to_numpy()[order]
    edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-2))
    lists = {int(numbers[s]): (slots[s:e], impacts[s:e]) for s, e in zip(edges[:-1], edges[1:])}
    out = [(-1, -1, len(docs), 0, [], None, None, docs["doc_id"].to_numpy())]
    for term, (s, i) in lists.items():
        out.append((term, -1, len(s), int(i.max()), largest(i, k), s, i, None))
    for a, b in pairs.tolist():
        if a in lists and b in lists:
            out.append((a, b, *joint_top(*lists[a], *lists[b], k), None, None, None))
    return pd.DataFrame(out, columns=["a", "b", "size", "top", "best", "slots", "impacts", "doc_ids"]).assign(
        item_block=item_block, block=block)[INDEX_COLUMNS]


INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def prefix_bounds(tops: list[int], pair_top) -> list[int]:
    """bounds[j]: no document's impacts of the first ``j`` terms exceed it in sum.

    A document has either both terms of a pair, and then at most their joint maximum, or at most one of them. So a pair
    counts with the larger of its joint maximum and its two maxima, which is never above their sum. Terms up to ``REACH``
    apart are paired; the cheapest pairing of each prefix follows from those of shorter ones.
    """
    def pair(i, j):
        return max(pair_top(i, j), tops[i], tops[j])

    bounds = [0]
    for j in range(1, len(tops) + 1):
        options = [bounds[j - 1] + tops[j - 1]]
        if j >= 2:
            options.append(bounds[j - 2] + pair(j - 2, j - 1))
        if j >= 3:
            options.append(bounds[j - 3] + pair(j - 3, j - 1) + tops[j - 2])
        if j >= 4:
            options.append(bounds[j - 4] + min(pair(j - 4, j - 2) + pair(j - 3, j - 1), pair(j - 4, j - 1) + pair(j - 3, j - 2)))
        bounds.append(min(options))
    return bounds


def search_block(items: list[tuple[int, list[int], int]], lists: dict, pair_tops: dict, n_docs: int, k: int):
    """(item, slots, scores) of the at most ``k`` best documents of one block for each item (number, terms by rising weight, least score).

    Only documents in the lists of essential terms are candidates: the shortest run of last terms for which the bound of
    all terms before them stays below the ``k``-th best score so far. The other terms are looked up from the heaviest on, and candidates whose
    score and remaining bound fall short go.
    """
    empty = np.zeros(0, np.int32), np.zeros(0, np.int64)
    total = np.zeros(n_docs, dtype=np.int64)
    for item, own, floor in items:
        own = [t for t in own if t in lists]
        tops = [int(lists[t][1].max()) for t in own]
        bounds = prefix_bounds(tops, lambda i, j: pair_tops.get((own[i], own[j]), 0))
        least, j = max(floor, 1), len(own)
        touched = []
        # Essential lists, the heaviest first, until all other terms together cannot reach the least score.
        while j and bounds[j] >= least:
            j -= 1
            slots, impacts = lists[own[j]]
            total[slots] += impacts
            touched.append(slots)
            if sum(map(len, touched)) >= k:
                kth = largest(total[np.unique(np.concatenate(touched))], k)
                least = max(least, int(kth[k - 1]) if len(kth) == k else 0)
        found = np.unique(np.concatenate(touched)) if touched else empty[0]
        score = total[found]
        total[found] = 0
        while len(found):
            if len(found) > k:
                least = max(least, int(np.partition(score, -k)[-k]))
            keep = score + bounds[j] >= least
            found, score = found[keep], score[keep]
            if not j:
                break
            j -= 1
            slots, impacts = lists[own[j]]
            at = np.searchsorted(slots, found)
            at[at == len(slots)] = 0
            score = score + np.where(slots[at] == found, impacts[at], 0)
        order = np.lexsort((found, -score))[:k]
        yield item, found[order], score[order]


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_block, term): the distinct terms of each item, items dealt into blocks of about ``ITEM_ROWS``."""
    rows = items.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).distinct()
    blocks = max(1, -(-items.count() // ITEM_ROWS))
    return rows.withColumn("item_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text", doc_col: str = "doc_id",
                   doc_text: str = "text", index: str | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties to the smaller doc_id.

    The score sums, over an item's distinct terms, weight * ((10**9 * tf) div (1000 * tf + 20 * m)), where a term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))) and m = 50 + (50 * n * N) div L for a document of n terms; N documents hold terms, L in all.

    A null or empty text has no terms; an item without any gives no rows. Rows with a null id take no part, not even in N, L and df.
    Documents that share a doc_id are ranked one by one, under the same id; items that share an item_id are one item with all their terms.
    Empty tables give no rows; other columns are ignored. ``index`` names a folder in which the index stays.

    Only terms of items are indexed. Postings are built by a join and a count, cut by hash into blocks of about ``BLOCK_DOCS`` documents;
    a task builds the lists of one block: of each term, with its impacts and their maximum, and of each pair of neighbouring terms of an item, with
    its joint maximum and its ``k`` best joint impacts. Over all blocks the ``k``-th best of a list is a score that ``k`` documents reach, so the
    largest one over an item's lists bounds its result from below before the search begins. A task then searches one block for
    one block of items, and the ``k`` best of each are merged in two levels. The items are a stated query set; neither side is gathered whole.
    """
    spark = docs.sparkSession
    vocabulary = settle(item_terms(items, item_col, item_text), "search-items")
    # A document's terms, without the text; the row number tells documents of one id apart and is read from the table, never computed twice.
    rows = docs.filter(F.col(doc_col).isNotNull()).select(
        F.col(doc_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), terms(F.col(doc_text)).alias("t"))
    counted = rows.select("doc_id", "row", F.size("t").cast("long").alias("n"), F.explode("t").alias("term"))
    known = vocabulary.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id())
    known = settle(known, "search-terms")
    postings = settle(counted.join(known, "term").groupBy("row", "doc_id", "n", "term_no").agg(F.count("*").alias("tf")), "search-postings")
    size = F.size(terms(F.col(doc_text))).cast("long")
    stats = docs.filter(F.col(doc_col).isNotNull()).select(size.alias("n")).agg(
        F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = stats["docs"], stats["terms"] or 0

    df = postings.groupBy("term_no").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = settle(df.select("term_no", "df", weight.alias("w")), "search-weights")
    sums = weights.agg(F.sum("df").alias("n")).first()
    blocks = max(1, -(-n_docs // BLOCK_DOCS), -(-(sums["n"] or 0) // BLOCK_POSTINGS))
    # Terms of an item by rising weight, and the pairs of neighbours in that order.
    own = vocabulary.join(known, "term").join(weights, "term_no").groupBy("item_block", "item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("w", "term_no"))), lambda t: t["term_no"]).alias("terms"))
    own = settle(own, "search-queries")
    at = F.explode(F.sequence(F.lit(0), F.size("terms") - 1))
    near = F.slice("terms", F.col("i") + 2, F.lit(REACH))
    pairs = own.select("item_block", "item_id", "terms", at.alias("i")).select(
        "item_block", "item_id", F.get("terms", F.col("i")).alias("a"), F.explode(near).alias("b"))
    pairs = settle(pairs, "search-pairs")
    of_block = pairs.groupBy("item_block").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))

    m = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {max(n_terms, 1)}L")
    scored = postings.join(weights.select("term_no", "w"), "term_no").select(
        "row", "doc_id", "term_no", m.alias("m"), "tf", "w").select(
        "row", "doc_id", "term_no", (F.col("w") * F.expr(f"({UNIT}L * tf) div (1000L * tf + 20L * m)")).alias("impact"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    homes = vocabulary.join(known, "term").select("term_no", "item_block").distinct()
    parts = scored.join(homes, "term_no")

    def build(key, postings: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(postings):
            return pd.DataFrame({c: [] for c in INDEX_COLUMNS})
        both = [(p["a"], p["b"]) for ps in pairs["pairs"] for p in ps]
        return build_block(int(key[0]), int(key[1]), postings, np.array(sorted(both), dtype=np.int64).reshape(-1, 2), k)

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    wanted = of_block.select(F.col("item_block").alias("ib"), every_block, "pairs").withColumnRenamed("block", "bl")
    lists = parts.groupBy("item_block", "block").cogroup(wanted.groupBy("ib", "bl")).applyInPandas(build, INDEX)
    index = index or scratch_path(spark, "search-index")
    lists.write.mode("overwrite").parquet(index)
    lists = spark.read.schema(INDEX).parquet(index)

    # The least score that the k-th best document of an item can have.
    top = Window.partitionBy("item_block", "a", "b").orderBy(F.desc("score"))
    kth = lists.filter("a >= 0").select("item_block", "a", "b", F.explode("best").alias("score")).withColumn(
        "place", F.row_number().over(top)).filter(F.col("place") <= k).groupBy("item_block", "a", "b").agg(
        F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).select("item_block", "a", "b", "kth")
    reached = pairs.unionByName(own.select("item_block", "item_id", F.explode("terms").alias("a"), F.lit(-1).cast("long").alias("b")))
    floors = reached.join(kth, ["item_block", "a", "b"]).groupBy("item_id").agg(F.max("kth").alias("floor"))
    asked = own.join(floors, "item_id", "left").select(
        F.col("item_block").alias("ib"), "item_id", "terms", F.coalesce("floor", F.lit(0)).cast("long").alias("floor"), every_block)
    asked = asked.withColumnRenamed("block", "bl")

    def search(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"item_id": [], "doc_id": [], "score": [], "block": []}).astype("int64")
        if not len(lists) or not len(asked):
            return out
        single = lists[(lists["a"] >= 0) & (lists["b"] < 0)]
        tops = {(a, b): t for a, b, t in zip(lists["a"], lists["b"], lists["top"]) if b >= 0}
        postings = {a: (np.asarray(s), np.asarray(i)) for a, s, i in zip(single["a"], single["slots"], single["impacts"])}
        doc_ids = np.asarray(lists.loc[lists["a"] < 0, "doc_ids"].iloc[0])
        items = [(i, list(t), f) for i, t, f in zip(asked["item_id"], asked["terms"], asked["floor"])]
        found = [pd.DataFrame({"item_id": item, "doc_id": doc_ids[slots], "score": scores})
                 for item, slots, scores in search_block(items, postings, tops, len(doc_ids), k)]
        return pd.concat(found).assign(block=int(lists["block"].iloc[0])).astype("int64")

    hits = lists.groupBy("item_block", "block").cogroup(asked.groupBy("ib", "bl")).applyInPandas(
        search, "item_id long, doc_id long, score long, block long")
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    merged = hits.withColumn("branch", F.expr("block div 32")).withColumn(
        "place", F.row_number().over(best("item_id", "branch"))).filter(F.col("place") <= k)
    return merged.withColumn("rank", F.row_number().over(best("item_id"))).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
