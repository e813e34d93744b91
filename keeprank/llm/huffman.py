"""A token-id file: canonical length-limited Huffman code from global counts, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keeprank.llm.bpe import DEFAULT_FILE, encoder, tokenizer_path
from keeprank.llm.storage import put, settle
from keeprank.session import scratch_path

BLOCK_TOKENS = 65_536
CHECKPOINT_TOKENS = 512
LIMIT = 16
BATCH_TOKENS = 2_000_000
SLICE_BYTES = 6_000_000
MAGIC = b"KRH1"
HEAD = "<4sIQIIQI"  # magic, documents, tokens, checkpoint interval, code limit, bits, crc of the rest


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``limit`` (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words of a canonical code: by length, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) for every word of as many bits as the longest code."""
    width = int(lengths.max(initial=1))
    codes = canonical_codes(lengths)
    ids, bits = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (width - lengths[used].astype(np.int64))
    first = int(codes[used[0]]) << (width - int(lengths[used[0]])) if len(used) else 0
    ids[first:first + int(spans.sum())] = np.repeat(used, spans)
    bits[first:first + int(spans.sum())] = np.repeat(lengths[used], spans)
    return ids, bits, width


def pack_bits(words: np.ndarray, width: np.ndarray, at: np.ndarray, bits: int) -> bytes:
    """Code words one after another, first bit first. ``at`` is where each begins; a word has 1 to 64 bits."""
    cell, end = at >> 6, (at & 63) + width
    over = np.flatnonzero(end > 64)
    own = words << np.where(end > 64, 0, 64 - end).astype(np.uint64)
    own[over] = words[over] >> (end[over] - 64).astype(np.uint64)
    packed = np.zeros((bits + 63) // 64, dtype=np.uint64)
    if len(at):
        # Words that begin in one cell follow each other, and at most one of them runs over into the next cell.
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        packed[cell[first]] = np.bitwise_or.reduceat(own, first)
        packed[cell[over] + 1] |= words[over] << (128 - end[over]).astype(np.uint64)
    return packed.astype(">u8").tobytes()[:(bits + 7) // 8]


def encode_block(doc_ids: list, doc_lengths: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray,
                 interval: int = CHECKPOINT_TOKENS) -> bytes:
    """Header, document ids (with a null mark) and lengths, checkpoints, bits."""
    width = lengths[ids].astype(np.int64)
    at = np.cumsum(width) - width
    bits = int(width.sum())
    docs = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8").tobytes()
    nulls = bytes(d is None for d in doc_ids)
    body = b"".join([docs, nulls, doc_lengths.astype("<u8").tobytes(), at[::interval].astype("<u8").tobytes(),
                     pack_bits(codes[ids], width, at, bits)])
    return struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), interval, int(lengths.max(initial=1)), bits, zlib.crc32(body)) + body


def decode_blocks(blocks: list[bytes], table: tuple[np.ndarray, np.ndarray, int]):
    """For each block (document ids, document lengths, ids). All checkpoint spans of all blocks advance side by side."""
    symbol, size, width = table
    parsed, streams, starts, counts = [], [], [], []
    base = 0
    for block in blocks:
        magic, n_docs, n, interval, limit, bits, crc = struct.unpack_from(HEAD, block)
        if magic != MAGIC or zlib.crc32(block[struct.calcsize(HEAD):]) != crc:
            raise ValueError("damaged block")
        at = struct.calcsize(HEAD)
        docs = np.frombuffer(block, "<i8", n_docs, at).tolist()
        nulls = block[at + 8 * n_docs:at + 9 * n_docs]
        docs = [None if gone else d for d, gone in zip(docs, nulls)]
        at += 9 * n_docs
        lens = np.frombuffer(block, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        spans = -(-n // interval)
        points = np.frombuffer(block, "<u8", spans, at).astype(np.int64)
        data = np.frombuffer(block, np.uint8, (bits + 7) // 8, at + 8 * spans)
        starts.append(points + 8 * base)
        counts.append(np.minimum(interval, n - interval * np.arange(spans)))
        streams.append(data)
        base += len(data)
        parsed.append((docs, lens, n, interval))
    data = np.concatenate([*streams, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    pos, left = np.concatenate(starts), np.concatenate(counts)
    out = np.zeros((int(left.max(initial=0)), len(pos)), dtype=np.uint32)
    last = len(window) - 1
    for step in range(len(out)):
        word = (window[np.minimum(pos >> 3, last)] >> (32 - width - (pos & 7)).astype(np.uint32)) & ((1 << width) - 1)
        out[step] = symbol[word]
        pos = pos + size[word]
    flat, first = out.T, 0
    for (docs, lens, n, interval), count in zip(parsed, counts):
        rows = flat[first:first + len(count)]
        first += len(count)
        yield docs, lens, rows.reshape(-1)[:n] if rows.shape[1] == interval else np.concatenate(
            [r[:c] for r, c in zip(rows, count)] or [np.zeros(0, np.uint32)])


def tokenise_in_order(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of about ``BLOCK_TOKENS`` ids in ascending doc_id order inside range partitions ``part``. One more row a partition
    has no documents but ``counts``, how often each id occurs in it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tokenise(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held_docs, held_ids, tokens = [], [], 0
        enc = encoder(path)
        total = np.zeros(enc.chunks.size, dtype=np.int64)

        def row(counts=None):
            nonlocal total
            ids = np.concatenate([np.zeros(0, enc.dtype), *held_ids])
            own = np.bincount(ids, minlength=len(total))
            own[:len(total)] += total
            total = own
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([held_docs], pa.list_(pa.int64())), pa.array([[len(i) for i in held_ids]], pa.list_(pa.int64())),
                pa.array([ids.astype("<u4" if enc.dtype.itemsize == 4 else "<u2").tobytes()], pa.binary()),
                pa.array([tokens], pa.int64()), pa.array([counts], pa.binary())],
                ["part", "block", "before", "doc_ids", "lens", "ids", "n_tokens", "counts"])

        for batch in batches:
            for a, b, texts in enc.slices(batch.column(1), SLICE_BYTES):
                ids, at = enc.encode(texts)
                end = np.array([end_id], dtype=ids.dtype)
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    held_docs.append(doc)
                    held_ids.append(np.concatenate([ids[at[i]:at[i + 1]], end]))
                    tokens += len(held_ids[-1])
                    if tokens >= BLOCK_TOKENS:
                        yield row()
                        block, before, tokens, held_docs, held_ids = block + 1, before + tokens, 0, [], []
        if held_docs:
            yield row()
            block, before, tokens, held_docs, held_ids = block + 1, before + tokens, 0, [], []
        yield row(total.astype("<i8").tobytes())

    tie = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(
        parts, "doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(
        tokenise, "part int, block int, before long, doc_ids array<long>, lens array<long>, ids binary, n_tokens long, counts binary")


def write_token_file(docs: DataFrame, target: str, path: str | None = None, end_id: int = 2, limit: int = LIMIT) -> None:
    """Write the ids of every text, each followed by ``end_id``, to the folder ``target`` in ascending doc_id order.

    ``target/codes`` holds the code length of each id, from counts over all documents; ``target/blocks`` holds
    the blocks (part, block, start, n_tokens, payload), in the order of (part, block). A block holds whole
    documents and can be decoded alone; inside it a checkpoint every ``CHECKPOINT_TOKENS`` ids gives the bit to
    start at. A null or empty text is the end id alone; null document ids come first; rows that repeat a
    doc_id follow each other. No documents make an empty file. Other columns are ignored.
    """
    path = path or tokenizer_path(DEFAULT_FILE)
    spark = docs.sparkSession
    ordered = settle(tokenise_in_order(docs, path, end_id), "token-ids", compression="zstd")
    dtype = np.dtype(encoder(path).dtype)

    def count(batches):
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0):
                own = np.frombuffer(counts.as_buffer(), "<i8")
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[:len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    # One row per vocabulary entry and one per part: both bounded, whatever the number of documents.
    seen = ordered.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ends = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toPandas()
    counts = np.zeros(int(seen["id"].max()) + 1 if len(seen) else 1, dtype=np.int64)
    counts[seen["id"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    first = dict(zip(ends["part"].tolist(), (ends["n"].cumsum() - ends["n"]).tolist()))

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i] for j, k in enumerate(batch.schema.names)}
                payload = encode_block(row["doc_ids"].as_py(), row["lens"].values.to_numpy(zero_copy_only=False),
                                       np.frombuffer(row["ids"].as_buffer(), dtype), lengths, codes)
                part = row["part"].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([row["block"].as_py()], pa.int32()),
                    pa.array([first[part] + row["before"].as_py()], pa.int64()), pa.array([row["n_tokens"].as_py()], pa.int64()),
                    pa.array([payload], pa.binary())], ["part", "block", "start", "n_tokens", "payload"])

    put(ordered.filter("counts IS NULL").drop("counts").mapInArrow(encode, "part int, block int, start long, n_tokens long, payload binary"),
        f"{target}/blocks", compression="none")
    used = np.flatnonzero(lengths)
    table = pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used].astype(np.int32), pa.int32())})
    spark.createDataFrame(table, "id long, length int").write.mode("overwrite").parquet(f"{target}/codes")


def read_token_file(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the file."""
    entries = spark.read.schema("id long, length int").parquet(f"{target}/codes").toPandas()
    lengths = np.zeros(int(entries["id"].max()) + 1 if len(entries) else 1, dtype=np.uint8)
    lengths[entries["id"].to_numpy(dtype=np.int64)] = entries["length"].to_numpy()
    table = decode_table(lengths)

    def decode(batches):
        def rows(group):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for start, (docs, lens, ids) in zip([s for s, _ in group], decode_blocks([p for _, p in group], table)):
                ends = np.cumsum(lens)
                for doc, n, end in zip(docs, lens.tolist(), ends.tolist()):
                    own = ids[end - n:end].astype("<u4")
                    for col, v in zip(cols, (doc, start + end - n, n, zlib.crc32(own))):
                        col.append(v)
                    if with_ids:
                        cols[4].append(own.astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(arrays)])

        for batch in batches:
            group, tokens = [], 0
            for start, n, payload in zip(*(batch.column(j) for j in range(3))):
                group.append((start.as_py(), payload.as_py()))
                tokens += n.as_py()
                if tokens >= BATCH_TOKENS:
                    yield rows(group)
                    group, tokens = [], 0
            if group:
                yield rows(group)

    blocks = spark.read.schema("part int, block int, start long, n_tokens long, payload binary").parquet(f"{target}/blocks")
    return blocks.select("start", "n_tokens", "payload").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def token_file_digest(docs: DataFrame, target: str | None = None, path: str | None = None) -> DataFrame:
    """Write the file and read it back."""
    target = target or scratch_path(docs.sparkSession, "token-file")
    write_token_file(docs, target, path)
    return read_token_file(docs.sparkSession, target)
