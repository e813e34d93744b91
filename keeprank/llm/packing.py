"""Hierarchical packing: documents go to context-size tiers, gaps of long windows are filled from shorter tiers."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from keeprank.llm.bpe import DEFAULT_FILE, encoder, tokenizer_path

TIERS = (128, 256, 512, 1024)
END_ID = 0
BUFFER_TOKENS = 250_000
STEP_TOKENS = 65_536
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
          " tier int, step_group long")


def pack_tiers(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[list[list[tuple[int, int, int]]], list]:
    """(full windows, the pieces of at most one window that stayed short); a piece is (row, start, length).

    A document first fills windows of the largest tier. What remains is routed to the shortest tier that holds
    it. Windows are opened for the longest remainders first; a gap takes the longest remainder that fits, and
    when none fits, the shortest one is cut, so that every window but the last is full.
    """
    windows: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []
    top = tiers[-1]
    for row, n in enumerate(lengths.tolist()):
        cut = n - n % top
        windows.extend([(row, s, top)] for s in range(0, cut, top))
        if n > cut:
            pool.append((n - cut, row, cut))
    pool.sort()
    while pool:
        n, row, start = pool.pop()
        window, gap = [(row, start, n)], tiers[bisect_left(tiers, n)] - n
        while gap and pool:
            at = bisect_right(pool, gap, key=lambda p: p[0])
            if at:
                n, row, start = pool.pop(at - 1)
                window.append((row, start, n))
                gap -= n
            else:
                n, row, start = pool.pop(0)
                window.append((row, start, gap))
                insort(pool, (n - gap, row, start + gap))
                gap = 0
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def balanced_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each window: the longest first, each to the group with the fewest tokens so far."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        used, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (used + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A document is its token ids followed by ``end_id``; a null or empty text is that one id. Each id lies in exactly one
    piece. Sequences are full at the length of a tier (powers of two); only one sequence per input partition can stay short and is padded to
    the longest tier (to none at a power of two). ``tier`` is the length of the sequence with padding, ``step_group`` a group of
    sequences with about ``STEP_TOKENS`` tokens. With ``with_ids`` a column ``ids`` (array) holds the ids of
    the piece. Null document ids are kept; rows that repeat an id are packed as documents of their own.
    No documents give no rows. Columns other than ``doc_id`` and ``text`` are ignored.

    Each task packs its own partition with a buffer of bounded size (one document may be larger), so nothing is
    shuffled. ``sequence_id`` is the partition's number times 2**33 plus a running number.
    """
    path = path or tokenizer_path(DEFAULT_FILE)
    tiers = tuple(sorted(tiers))

    def pack(batches):
        base = TaskContext.get().partitionId() << 33
        made, steps = 0, 0
        held: list[tuple] = []  # (doc_id, ids, start, doc_tokens): whole documents, and pieces that wait for the next buffer
        tokens = 0

        def flush(last: bool):
            nonlocal made, steps, held, tokens
            windows, rest = pack_tiers(np.array([len(h[1]) for h in held], dtype=np.int64), tiers)
            if last and rest:
                windows, rest = [*windows, rest], []
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = balanced_groups(sizes)
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                     "offset", "tier", "step_group", "ids")}
            for number, (window, size, group) in enumerate(zip(windows, sizes, groups)):
                offset = 0
                tier = size if size & (size - 1) == 0 else tiers[-1]
                for row, start, length in window:
                    doc, ids, before, total = held[row]
                    own = ids[start:start + length].astype("<u4")
                    for k, v in zip(cols, (doc, before + start, length, zlib.crc32(own), total, base + made + number, offset,
                                           tier, base + steps + group)):
                        cols[k].append(v)
                    if with_ids:
                        cols["ids"].append(own.astype(np.int32))
                    offset += length
            made += len(windows)
            steps += max(groups, default=-1) + 1
            held = [(held[r][0], held[r][1][s:s + n].copy(), held[r][2] + s, held[r][3]) for r, s, n in rest]
            tokens = sum(len(h[1]) for h in held)
            fields = [pa.array(cols[k], pa.int32() if k == "tier" else pa.int64()) for k in list(cols)[:-1]]
            names = list(cols)[:-1]
            if with_ids:
                fields, names = [*fields, pa.array(cols["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(fields, names)

        enc = encoder(path)
        for batch in batches:
            names = batch.column(0)
            for a, b, texts in enc.slices(batch.column(1)):
                ids, at = enc.encode(texts)
                end = np.array([end_id], dtype=ids.dtype)
                for i, doc in enumerate(names.slice(a, b - a).to_pylist()):
                    own = np.concatenate([ids[at[i]:at[i + 1]], end])
                    held.append((doc, own, 0, len(own)))
                    tokens += len(own)
                    if tokens >= BUFFER_TOKENS:
                        yield flush(False)
        if held:
            yield flush(True)
        pa.default_memory_pool().release_unused()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(pack, schema)
