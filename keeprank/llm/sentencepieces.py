"""SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model's protobuf and checked against it."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keeprank.llm.bpe import Cache, Chunks, TextEncoder, encoder, tokenizer_path
from keeprank.llm.pieces import BPE, BYTE, NORMAL, USER_DEFINED, PieceModel, read_model

MODEL = "piece_bpe_32k.model"
MARK = "▁"
THREADS = 2


def merge_rules(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs that make a piece, pieces of the highest score first: the order in which the model merges."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    order = sorted(((-score[p], i, p) for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED) and len(p) > 1))
    return [(p[:i], p[i:]) for _, _, p in order for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def rebuild(model: PieceModel):
    """A tokenizers pipeline with the model's normaliser, marker, scores and byte fallback."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    names = [p for p, _, _ in model.pieces]
    if model.model_type == BPE:
        core = models.BPE(vocab={p: i for i, p in enumerate(names)}, merges=merge_rules(model), unk_token=names[model.unk_id],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        low = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        scores = [s if kind in (NORMAL, BYTE) else 0.0 if kind == USER_DEFINED else low - 10.0 for _, s, kind in model.pieces]
        core = models.Unigram(list(zip(names, scores)), model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(_spaces(), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else back)
    return out


def _spaces():
    from tokenizers import Regex

    return Regex(" {2,}")


class PieceChunks(Chunks):
    """Ids of words with the marker before them; equal words of a slice are encoded once.

    No piece of the model may hold a marker after another character (checked), so the words of a text are encoded independently. Words
    that are empty or hold a marker themselves make their text be encoded whole. Only words that come back by decoding are kept.
    """

    def __init__(self, path: str):
        # The library reads both when its first batch starts.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        self.cache = Cache()
        self.spec = read_model(path)
        self.tokenizer = rebuild(self.spec)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("H" if len(self.spec.pieces) <= 65_536 else "I")
        self.free = not any(MARK in p.lstrip(MARK) for p, _, kind in self.spec.pieces if kind in (NORMAL, USER_DEFINED)) and (
            self.spec.add_dummy_prefix and self.spec.escape_whitespaces)
        self.lossy: set[str] = set()  # words of this slice that don't come back by decoding

    def odd(self, word: str) -> bool:
        return not self.free or not word or MARK in word or bool(self.spec.charsmap) and MARK in self.tokenizer.normalizer.normalize_str(word)[1:]

    def led(self, words: pa.Array, spelled: list[str], often: np.ndarray) -> tuple[np.ndarray, ...]:
        found = self.cache.get(spelled)
        new = [i for i, v in enumerate(found) if v is None]
        odd = np.zeros(len(found), dtype=bool)
        odd[[i for i in new if self.odd(spelled[i])]] = True
        new = [i for i in new if not odd[i]]
        plain = [spelled[i] for i in new]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        self.lossy = set()
        for i, w, own, text in zip(new, plain, ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False)):
            found[i] = self.packed(own)
            if text != w:
                self.lossy.add(w)
            elif often[i]:
                self.cache.put(w, found[i])
        found = [v or b"" for v in found]
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        return np.frombuffer(b"".join(found), dtype=self.dtype), np.cumsum(length) - length, length, odd

    def bare(self, words: list[str]) -> list[bytes | None]:
        """A text's first word has the marker too."""
        fits = [not self.odd(w) for w in words]
        ids = iter(self.tokenizer.encode_batch_fast([w for w, fit in zip(words, fits) if fit], add_special_tokens=False))
        return [self.packed(next(ids).ids) if fit else None for fit in fits]


class PieceEncoder(TextEncoder):
    def table(self, path: str) -> Chunks:
        return PieceChunks(path)

    def verdicts(self, texts: pa.Array, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(same ids as the reference library, text comes back) per text of the slice encoded last. Each text is compared whole."""
        codes, bounds, uniq, strange = self.last
        c = self.chunks
        back = np.ones(len(strange), dtype=bool)
        if c.lossy:
            hit = np.fromiter((w in c.lossy for w in uniq), bool, len(uniq))[codes]
            back = np.add.reduceat(hit, bounds[:-1]) == 0
        same = np.zeros(len(strange), dtype=bool)
        for i in range(len(strange)):
            text, own = texts[i].as_py() or "", ids[at[i]:at[i + 1]]
            same[i] = np.array_equal(np.array(c.judge.encode(text), dtype=np.int64), own)
            if strange[i]:
                back[i] = c.tokenizer.decode(own.tolist(), skip_special_tokens=False) == text
        return same, back


def encode_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip[, ids]) for every row of ``docs``; crc of little-endian unsigned 32-bit ids.

    ``parity``: the sentencepiece library gives the same ids for the whole text. ``round_trip``: decoding gives the text back.
    Null and empty texts have no ids. Rows that repeat an id have a result each. No rows give none; other columns are ignored.
    """
    path = path or tokenizer_path(MODEL)

    def encode(batches):
        enc = encoder(path, PieceEncoder)
        for batch in batches:
            for a, b, texts in enc.slices(batch.column(1)):
                ids, at = enc.encode(texts)
                same, back = enc.verdicts(texts, ids, at)
                own = [ids[at[i]:at[i + 1]].astype("<u4") for i in range(b - a)]
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        pa.array(same), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + (
        ", ids array<int>" if with_ids else ""))


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from ``encoded(doc_id, ids)``; null ids give a null text."""
    path = path or tokenizer_path(MODEL)

    def decode(batches):
        tokenizer = encoder(path, PieceEncoder).chunks.tokenizer
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(texts) for x in ids], pa.string())],
                                             ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        decode, "doc_id long, text string")
