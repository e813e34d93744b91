"""Token ids of whole texts with a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import array
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "byte_bpe_50k.json"
CACHE_BYTES = 40_000_000
ENTRY_BYTES = 200
JOINED = 60
SLICE_BYTES = 3_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(texts: pa.Array) -> pa.Array:
    """A copy of a column, with null as empty, whose buffers start at its first text. Some kernels read a slice's buffers from
    their start once it is cast to large strings."""
    return pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())


class Cache:
    """Ids of words in two generations: what is used goes to the young one, and when that holds ``CACHE_BYTES`` it becomes the old
    one, so frequent words stay and rare ones go."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, words))
        old = self.old
        if old:
            for i, v in enumerate(found):
                if v is None and (v := old.get(words[i])) is not None:
                    found[i] = v
                    self.put(words[i], v)
        return found

    def put(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.held += ENTRY_BYTES + len(word) + len(ids)

    def turn(self) -> bool:
        """Between slices: whether the generations changed."""
        if self.held <= CACHE_BYTES:
            return False
        self.young, self.old, self.held = {}, self.young, 0
        return True


class Chunks:
    """Ids of chunks. A chunk is a run of text up to the next space, with the space before it; only a text's first one has none.

    Some chunks are cut in a way that depends on their neighbours: where a space stands between two white-space
    characters, or a special token's text occurs. Texts that hold one are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Cache()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("H" if self.size <= 65_536 else "I")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet spells each byte with one character, so a token has as many bytes as characters.
        self.bytes_of = np.ones(self.size, dtype=np.int32)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)

    def packed(self, ids) -> bytes:
        return array.array(self.dtype.char, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def bare(self, words: list[str]) -> list[bytes | None]:
        """Ids of first chunks; ``None`` for those that hold a special token."""
        return [None if any(s in w for s in self.specials) else self.packed(e.ids)
                for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False))]

    def bound(self, words: pa.Array) -> np.ndarray:
        """Which chunks, given without their space, are cut depending on their neighbours."""
        out = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        for s in self.specials:
            out = pc.or_(out, pc.match_substring(words, s))
        return out.to_numpy(zero_copy_only=False)

    def led(self, words: pa.Array, spelled: list[str], often: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, where those of each word begin, how many they are, which words are bound) for distinct words, each with a space before it.

        Such chunks never share a token with their neighbours, so the new ones are encoded in runs, whose ids are dealt back by
        their bytes. Those met ``often`` are kept for the next slices.
        """
        found = self.cache.get(spelled)
        new = np.flatnonzero(np.fromiter((v is None for v in found), bool, len(found)))
        fresh = words.take(pa.array(new))
        bound = self.bound(fresh)
        odd = np.zeros(len(found), dtype=bool)
        odd[new[bound]] = True
        new, fresh = new[~bound], fresh.filter(pa.array(~bound))
        size = pc.binary_length(fresh).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        edges = np.append(np.arange(0, len(new), JOINED), len(new))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), fresh), pa.scalar(" ", pa.large_string())).to_pylist()
        learned = [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)]
        flat = np.concatenate(learned) if learned else np.zeros(0, self.dtype)
        ends = np.searchsorted(np.cumsum(self.bytes_of[flat], dtype=np.int64), np.cumsum(size)) + 1 if len(new) else np.zeros(0, np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
        held = [v for v in found if v is not None]
        length = np.zeros(len(found), dtype=np.int64)
        known = np.fromiter((v is not None for v in found), bool, len(found))
        length[known] = np.fromiter(map(len, held), np.int64, len(held)) // self.dtype.itemsize
        length[new] = ends - starts
        # Ids of known words lie first, then those of the new ones.
        begin = np.zeros(len(found), dtype=np.int64)
        old = np.frombuffer(b"".join(held), dtype=self.dtype)
        begin[known] = np.cumsum(length[known]) - length[known]
        begin[new] = starts + len(old)
        every = often[new]
        for i, a, b in zip(new[every].tolist(), starts[every].tolist(), ends[every].tolist()):
            self.cache.put(spelled[i], flat[a:b].tobytes())
        return np.concatenate([old, flat]), begin, length, odd


class TextEncoder:
    """Encodes Arrow columns of texts; equal chunks of a slice are looked up once."""

    def __init__(self, path: str):
        self.chunks = self.table(path)
        self.dtype = self.chunks.dtype

    def table(self, path: str) -> Chunks:
        return Chunks(path)

    def slices(self, texts: pa.Array, slice_bytes: int | None = None):
        """Cut a column so that a slice has about ``SLICE_BYTES`` of text; one text is never cut."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) // (slice_bytes or SLICE_BYTES)) if len(size) else size
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-2)) if len(size) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(a), int(b), texts.slice(int(a), int(b - a))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts); null counts as empty."""
        texts = fresh(texts)
        known = self.chunks
        known.cache.turn()
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        uniq = coded.dictionary.to_pylist()
        firsts = bounds[:-1]
        flat, begin, length, odd = known.led(coded.dictionary, uniq, np.bincount(codes, minlength=len(uniq)) > 1)
        heads, place = np.unique(codes[firsts], return_inverse=True)
        opening = known.bare([uniq[c] for c in heads])
        opening = [opening[i] for i in place]
        strange = np.fromiter((v is None for v in opening), bool, len(opening))
        if odd.any():
            flags = odd[codes]
            flags[firsts] = False
            strange |= np.add.reduceat(flags, firsts) > 0
        self.last = codes.copy(), bounds, uniq, strange
        blank = len(length)
        for i in np.flatnonzero(strange):
            codes[bounds[i]:bounds[i + 1]] = blank
            opening[i] = known.whole(texts[int(i)].as_py())
        codes[firsts] = blank + 1 + np.arange(len(firsts))
        more = np.concatenate([np.zeros(1, np.int64), np.fromiter(map(len, opening), np.int64, len(opening)) // self.dtype.itemsize])
        begin = np.concatenate([begin, len(flat) + np.cumsum(more) - more])
        length = np.concatenate([length, more])
        flat = np.concatenate([flat, np.frombuffer(b"".join(opening), dtype=self.dtype)])
        per_word = length[codes]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_word)])
        kind = np.int32 if max(len(flat), ends[-1]) < 2 ** 30 else np.int64
        shift = begin.astype(kind)[codes] - ends[:-1].astype(kind)
        at = np.repeat(shift, per_word)
        at += np.arange(ends[-1], dtype=kind)
        return flat[at], ends[bounds]


def encoder(path: str, kind: type = TextEncoder) -> TextEncoder:
    """One per worker process and file. Functions reach workers by value, with new globals in every task, so what is to
    outlive a task hangs on a module of its own."""
    kept = sys.modules.setdefault("_text_encoders", types.ModuleType("_text_encoders")).__dict__
    name = f"{kind.__name__}:{path}"
    if name not in kept:
        kept[name] = kind(path)
    return kept[name]
