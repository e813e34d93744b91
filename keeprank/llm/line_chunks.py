"""Line dedup by content-defined chunks and the runs of repeated lines around them, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keeprank.llm.storage import settle

MODULUS = 3
FEWEST_WORDS = 20
LONG_LINE_WORDS = 50
FACTOR = 1_000_003
CHUNK, PAIR = 1, 2
PLACE = ("id", "digest", "first")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def chunks(lines: Column, modulus: int = MODULUS, long_line: int = LONG_LINE_WORDS) -> Column:
    """Array of (first, size, words): the chunks of an array of lines.

    A chunk ends after a line where the rolling hash of the last two line hashes is a multiple of ``modulus``, so that an
    inserted line moves no boundary but those beside it. A line of at least ``long_line`` words is a chunk of its own.
    """
    def ends(s: Column) -> Column:
        count = F.size(s["h"])
        before = lambda i: F.coalesce(F.get(s["h"], i - 1), F.lit(0).cast("long"))
        rolled = lambda i: before(i) * F.lit(FACTOR) + F.get(s["h"], i)
        is_long = lambda i: F.coalesce(F.get(s["w"], i) >= long_line, F.lit(False))
        return F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == count - 1) | (rolled(i) % modulus == 0)
                        | is_long(i) | is_long(i + 1))

    def spans(s: Column, e: Column) -> Column:
        first = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        return F.transform(e, lambda end, k: F.struct(
            first(k).alias("first"), (end - first(k) + 1).alias("size"),
            F.aggregate(F.slice(s["w"], first(k) + 1, end - first(k) + 1), F.lit(0), lambda a, w: a + w).alias("words")))

    hashed = F.struct(F.transform(lines, line_hash).alias("h"), F.transform(lines, words_in).alias("w"))
    return let(hashed, lambda s: let(ends(s), lambda e: spans(s, e)))


def removable(chunk: Column, fewest_words: int, long_line: int) -> Column:
    """Chunks that are worth removing: several lines with enough words, or one long line."""
    return (chunk["words"] >= fewest_words) & ((chunk["size"] >= 2) | (chunk["words"] >= long_line))


def units(keyed: DataFrame, modulus: int, fewest_words: int, long_line: int) -> DataFrame:
    """What can repeat in ``keyed(id, digest, lines)``, by place and hashes: removable chunks, and pairs of adjacent lines.

    ``head`` and ``tail`` are the words of a pair's two lines.
    """
    own = lambda lines: F.transform(F.filter(chunks(lines, modulus, long_line), lambda c: removable(c, fewest_words, long_line)),
                                    lambda c: F.struct(c["first"].alias("first"), c["size"].alias("size"), F.array_join(
                                        F.slice(lines, c["first"] + 1, c["size"]), "\n").alias("body")))
    blocks = keyed.select("id", "digest", F.inline(own(F.col("lines")))).select(
        "id", "digest", F.lit(CHUNK).alias("kind"), "first", "size", F.lit(0).alias("head"), F.lit(0).alias("tail"),
        F.xxhash64(F.lit(CHUNK), "body").alias("h1"), F.xxhash64(F.lit(CHUNK + 7), "body").alias("h2"))
    after = keyed.withColumn("after", F.slice("lines", 2, F.size("lines")))
    pairs = after.select("id", "digest", F.posexplode(F.arrays_zip("lines", "after")).alias("first", "l")).select(
        "id", "digest", "first", F.col("l.lines").alias("line"), F.col("l.after").alias("next")).filter("next IS NOT NULL").select(
        "id", "digest", F.lit(PAIR).alias("kind"), "first", F.lit(2).alias("size"), words_in(F.col("line")).alias("head"),
        words_in(F.col("next")).alias("tail"), F.xxhash64(F.lit(PAIR), "line", "next").alias("h1"),
        F.xxhash64(F.lit(PAIR + 7), "line", "next").alias("h2"))
    return blocks.unionByName(pairs)


def repeated_spans(keyed: DataFrame, modulus: int, fewest_words: int, long_line: int) -> DataFrame:
    """(id, digest, gone): per document the spans (first, size) of lines that stand at an earlier place.

    A span is a repeated chunk, or a longest run of lines whose adjacent pairs all stand earlier, of ``long_line`` words or
    more: the run goes on to both edges of a passage, wherever the chunks around it end. Hashes find what repeats, and
    the bytes of only that are compared.
    """
    every = units(keyed, modulus, fewest_words, long_line)
    repeated = settle(every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("keeper")).filter("n > 1").drop("n"),
                      "repeated-hashes")
    seen = settle(every.join(repeated, ["h1", "h2"]), "repeated-units")
    listed = seen.groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(
        F.collect_set(F.struct("h1", "h2", "first", "size")).alias("parts"))
    bodies = keyed.join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select("lines", F.explode("parts").alias("p")).select(
        "p.h1", "p.h2", F.array_join(F.slice("lines", F.col("p.first") + 1, F.col("p.size")), "\n").alias("body"))
    # Grouping by the text itself compares bytes. Hashes that two texts share are left alone.
    shared = settle(bodies.groupBy("h1", "h2", "body").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("texts")).filter(
        "texts > 1").select("h1", "h2"), "shared-hashes")
    later = seen.filter(~F.struct(*PLACE).eqNullSafe(F.col("keeper"))).join(shared, ["h1", "h2"], "left_anti")

    order = F.dense_rank().over(Window.partitionBy("id", "digest").orderBy("first"))
    pairs = later.filter(F.col("kind") == PAIR).select("id", "digest", "first", "head", "tail", (F.col("first") - order).alias("run")).groupBy(
        "id", "digest", "run", "first").agg(F.min("head").alias("head"), F.min("tail").alias("tail"))
    runs = pairs.groupBy("id", "digest", "run").agg(
        F.min("first").alias("first"), (F.count("*") + 1).cast("int").alias("size"),
        (F.min_by("head", "first") + F.sum("tail")).alias("words")).filter(F.col("words") >= long_line)
    spans = later.filter(F.col("kind") == CHUNK).select(*PLACE, "size").unionByName(runs.select(*PLACE, "size"))
    return spans.groupBy("id", "digest").agg(F.collect_set(F.struct("first", "size")).alias("gone"))


def drop_repeated_chunks(docs: DataFrame, modulus: int = MODULUS, fewest_words: int = FEWEST_WORDS,
                         long_line: int = LONG_LINE_WORDS, counts: bool = False, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the line chunks and runs of lines that stand elsewhere before; columns and all other text stay as they are.

    Of equal chunks (byte by byte) the one in the smallest doc_id stays, there the first one; null ids count as smallest. Chunks with fewer
    than ``fewest_words`` words, and single lines with fewer than ``long_line``, are never removed by themselves. A run of two lines or more with at
    least ``long_line`` words goes if each pair of adjacent lines in it stands at an earlier place, so a passage goes as a whole whatever surrounds
    it. Each removed line stands at an earlier place, so one copy of it always stays. Rows that repeat id and
    text are one document and get the same result. Null texts stay null, empty ones empty. A document whose lines are all removed is dropped
    (``drop_emptied``), or keeps an empty text. ``counts`` adds ``lines_before`` and ``lines_removed`` (long).
    Columns of any other name pass through; an empty table gives an empty one.

    Hashes and places travel; a text moves once for the comparison, if it holds something repeated, and once for the result.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("digest"), F.split(text, "\n", -1).alias("lines")).filter(
        "lines IS NOT NULL")
    extra = repeated_spans(keyed, modulus, fewest_words, long_line)

    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn(
        "key", F.xxhash64(F.col("row.text").cast("string")))
    joined = wide.join(extra, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("digest")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)

    def rest(s: Column) -> Column:
        removed = F.flatten(F.transform(s["gone"], lambda g: F.sequence(g["first"], g["first"] + g["size"] - 1)))
        stays = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), removed)
        return F.transform(stays, lambda i: F.get(s["lines"], i))

    remaining = F.when(F.col("gone").isNotNull(), let(F.struct(lines.alias("lines"), F.col("gone").alias("gone")), rest))
    cut = joined.select("row", "gone", remaining.alias("remaining"))
    if drop_emptied:
        cut = cut.filter("gone IS NULL OR size(remaining) > 0")
    cleaned = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("remaining", "\n"))
    out = [(cleaned if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names]
    if counts:
        before = F.coalesce(F.size(F.split(F.col("row.text").cast("string"), "\n", -1)), F.lit(0)).cast("long")
        before = F.when(F.col("row.text").isNull(), F.lit(0).cast("long")).otherwise(before)
        out += [before.alias("lines_before"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(
            before - F.size("remaining")).alias("lines_removed")]
    return cut.select(*out)
