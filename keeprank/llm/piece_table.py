"""Fill-in-the-middle by piece tables: documents are descriptors over immutable buffers, so nothing but descriptors moves."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20
BLOCK_CHARS = 1_000_000
BATCH_CHARS = 4_000_000

# Arrangements of the six pieces: 0, 1 and 2 are prefix, middle and suffix, 3, 4 and 5 the three sentinels.
ARRANGEMENTS = {"plain": (0, 1, 2), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


@dataclass(frozen=True)
class Piece:
    """``length`` code points of buffer ``buffer`` from ``start`` on."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """A sequence of pieces over buffers that are never changed or joined."""

    def __init__(self, buffers: list[str], pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls([text], [Piece(0, 0, len(text))])

    def cut(self, places: list[int]) -> PieceTable:
        """Split descriptors at ascending positions of the whole; equal positions leave empty pieces between them."""
        out, at, left = [], 0, list(self.pieces)
        for place in places:
            while at + left[0].length < place:
                at += left[0].length
                out.append(left.pop(0))
            head = place - at
            first = left.pop(0)
            out.append(Piece(first.buffer, first.start, head))
            left.insert(0, Piece(first.buffer, first.start + head, first.length - head))
            at = place
        return PieceTable(self.buffers, out + left)

    def append_buffer(self, parts: tuple[str, ...]) -> PieceTable:
        """One more piece for each part, all over one new buffer."""
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        more = [Piece(len(self.buffers), s, len(p)) for s, p in zip(starts, parts)]
        return PieceTable([*self.buffers, "".join(parts)], [*self.pieces, *more])

    def arrange(self, order) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def stream(self):
        """The characters in blocks of bounded size."""
        for p in self.pieces:
            for s in range(p.start, p.start + p.length, BLOCK_CHARS):
                yield self.buffers[p.buffer][s:min(s + BLOCK_CHARS, p.start + p.length)]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for block in self.stream():
            digest.update(block.encode())
        return digest.hexdigest()

    def text(self) -> str:
        return "".join(self.stream())


def inverse(order: tuple[int, ...]) -> list[int]:
    """The permutation that undoes ``order``."""
    return np.argsort(order).tolist()


class Units:
    """Units of a text: a run of ASCII letters, or any other single code point. Only a count per block is kept."""

    def __init__(self, text: str):
        self.text, self.before = text, [0]
        for at in range(0, len(text), BLOCK_CHARS):
            self.before.append(self.before[-1] + int(self.starts(at).sum()))

    def starts(self, at: int) -> np.ndarray:
        """Which code points of the block from ``at`` on begin a unit."""
        block = self.text[max(at - 1, 0):at + BLOCK_CHARS]
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lower = points | 32
        letter = (lower >= 97) & (lower <= 122)
        begins = ~letter
        begins[1:] |= ~letter[:-1]
        begins[:1] = True
        return begins[1:] if at else begins

    @property
    def n(self) -> int:
        return self.before[-1]

    def place(self, i: int) -> int:
        """Code points before unit ``i``; all of them for ``i`` = n."""
        if i == self.n:
            return len(self.text)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        return block * BLOCK_CHARS + int(np.flatnonzero(self.starts(block * BLOCK_CHARS))[i - self.before[block]])


def draws(doc_id: int, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transform(doc_id: int | None, text: str, seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW) -> tuple[PieceTable, str, int, int | None, int | None]:
    """(output, form, units, prefix characters, middle characters) of one document."""
    units, table = Units(text), PieceTable.of(text)
    if doc_id is None or not text or any(s in text for s in sentinels):
        return table, "plain", units.n, None, None
    h1, h2, h3, h4 = draws(doc_id, seed)
    if h3 % 100 >= plain_from:
        return table, "plain", units.n, None, None
    a, b = sorted((units.place(h1 % (units.n + 1)), units.place(h2 % (units.n + 1))))
    form = "spm" if h4 % 100 < spm_below else "psm"
    return table.cut([a, b]).append_buffer(sentinels).arrange(ARRANGEMENTS[form]), form, units.n, a, b - a


def restore(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> PieceTable:
    """The document, from its output and form alone. No sentinel stands in the text, nor can one arise where it
    meets a sentinel, so each is found once; the inverse permutation brings the pieces back in order."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order = ARRANGEMENTS[form]
    places, at = [], 0
    for i in order:
        if i >= 3:
            at = output.index(sentinels[i - 3], at)
            places += [at, at + len(sentinels[i - 3])]
            at = places[-1]
    return table.cut(places[1:]).arrange(inverse(order)[:3])


def fill_in_middle(docs: DataFrame, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of every document.

    A text is cut into ``n`` units; the sha256 of ``seed:doc_id`` draws two cuts and the form: ``plain``, ``psm`` (prefix, suffix,
    middle) or ``spm`` (suffix, prefix, middle), each part behind its sentinel. ``restored_sha256`` is of the text rebuilt from output
    and form. ``with_text`` adds the output itself.

    A null text is an empty one. A document that is empty, holds a sentinel, or has a null ``doc_id`` (nothing to draw from) stays
    plain. Rows that repeat a doc_id draw alike and are rows of their own. No documents give no rows. Other
    columns are ignored. ``sentinels`` must not be able to overlap themselves or each other.

    Each row is on its own, so nothing is shuffled; long texts are scanned and hashed in blocks.
    """
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                            ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
                           + ([("output", pa.string())] if with_text else []))
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                table, form, n, prefix, middle = transform(doc_id, text, seed, sentinels, plain_from, spm_below)
                output = table.text()
                row = (doc_id, n, form, prefix, middle, table.sha256(), restore(output, form, sentinels).sha256())
                rows.append((*row, output) if with_text else row)
                held += len(output) if with_text else 0
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
        + (", output string" if with_text else ""))
