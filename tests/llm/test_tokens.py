"""Token ids, the token file, packing and SentencePiece against the libraries themselves."""

import collections
import heapq
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keeprank.llm import bpe
from keeprank.llm import huffman as hf
from keeprank.llm import packing as pk
from keeprank.llm.bpe import DEFAULT_FILE, encoder, tokenizer_path
from keeprank.llm.pieces import BPE, read_model
from keeprank.llm.sentencepieces import MODEL, PieceEncoder, decode_pieces, encode_pieces, merge_rules, rebuild

NASTY = ["", " ", "  ", "a  b", "a   b", "x\n  b", "a \n b", "  lead", "tail ", "tail  ", "\n\n x", "\t\n y\n", "don't we'll I'd", "a,b.c,",
         "é è ²½ x² 5x", "foo<|endoftext|>bar baz", "<|endoftext|>", "日本語 テキスト。 あ 𠮷😀", "a\r\nb \r\n c", "!!! ... ?! (a) ,, ..", "w.\nN w,\n N",
         None, "\x00 a\x00b \x85 c", "1234 56.78, 9", "ﬁ ǅ ª º x_y _z", "aaaa" * 500, "many words of one text " * 300]
DOCS = "doc_id long, text string, ids string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 29, t, "x", 1) for i, t in enumerate(NASTY)] + [(None, "no id", "x", 1), (5, "again", "x", 1), (5, "again", "x", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(DEFAULT_FILE))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunked_ids_equal_the_library(library):
    column = pa.array(["skipped text"] * 3 + NASTY).slice(3)
    ids, at = encoder(tokenizer_path(DEFAULT_FILE)).encode(column)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in NASTY]


def test_small_caches_change_no_ids(library, monkeypatch):
    """Runs of two words, generations that turn at every slice, words met again after they went."""
    monkeypatch.setattr(bpe, "JOINED", 2)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 600)
    enc = bpe.TextEncoder(tokenizer_path(DEFAULT_FILE))
    for round_ in range(3):
        texts = [f"{t} {t} w{i % 5} w{i % 5} déjà {i}, x" for i, t in enumerate(NASTY[round_:])] + NASTY
        ids, at = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in texts]
    assert enc.chunks.cache.old and len(enc.chunks.cache.young) < 60


def test_unigram_pipeline_equals_sentencepiece():
    """The other kind of model: scores, marker and byte fallback rebuilt from a hand-made protobuf."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces = ["▁", "a", "b", "n", "d", "s", "▁a", "an", "▁ban", "ana", "▁banana", "nas", "and", "▁and", "ban", "s▁"][:-1]
    names += [(p, -1.0 - 0.7 * i, 1) for i, p in enumerate(pieces)]
    model = pb.ModelProto()
    for p, score, kind in names:
        model.pieces.add(piece=p, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = True
    model.normalizer_spec.remove_extra_whitespaces = False
    judge = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    with tempfile.NamedTemporaryFile(dir="/tmp", suffix=".model") as f:
        f.write(model.SerializeToString())
        f.flush()
        own = rebuild(read_model(f.name))
    for text in ("banana", "bananas and bananas", "an a b", "ñand zé", "dsnab sss", "banana 𠮷"):
        ids = own.encode(text, add_special_tokens=False).ids
        assert ids == judge.encode(text) and own.decode(ids, skip_special_tokens=False) == text


def cost(counts, limit):
    """Cost of the best code by plain Huffman; None where a word would be longer than the limit."""
    heap = [(int(c), 0) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, (a + b, max(x, y) + 1))
    return total if heap[0][1] <= limit else None


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = rng.zipf(1.5, 200).astype(np.int64) * (rng.random(200) < 0.8)
    for limit in (8, 10, 30):
        lengths = hf.code_lengths(counts, limit)
        assert lengths.max() <= limit and (lengths[counts > 0] > 0).all() and not lengths[counts == 0].any()
        assert np.isclose((2.0 ** -lengths[lengths > 0].astype(float)).sum(), 1)
        best = cost(counts, limit)
        assert best is None or best == (lengths * counts).sum()
    codes = hf.canonical_codes(lengths)
    words = [format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 3000).astype("u2")
    lengths = hf.code_lengths(np.bincount(ids, minlength=3000))
    block = hf.encode_block([4, None], np.array([n // 3, n - n // 3]), ids, lengths, hf.canonical_codes(lengths))
    for got in hf.decode_blocks([block, block], hf.decode_table(lengths)):
        assert got[0] == [4, None] and got[1].tolist() == [n // 3, n - n // 3] and (got[2] == ids).all()
    with pytest.raises(ValueError):
        list(hf.decode_blocks([block[:-1] + bytes([block[-1] ^ 1])], hf.decode_table(lengths)))


def test_token_file(spark, docs, library, monkeypatch, tmp_path):
    monkeypatch.setattr(hf, "BLOCK_TOKENS", 700)
    target = f"file://{tmp_path}/ids"
    hf.write_token_file(docs, target)
    got = sorted((r.asDict() for r in hf.read_token_file(spark, target, with_ids=True).collect()), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], (library(r["text"]) + [2])) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in got) == sorted((d or -1, tuple(i)) for d, i in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]
    assert hf.token_file_digest(docs.limit(0)).count() == 0


def check_packing(pieces, want):
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    for doc, ids in want.items():
        at = 0
        for r in sorted(documents[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    return padding, len(sequences)


def test_packing(spark, library, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join("word" for _ in range(n)) for n in rng.geometric(0.004, 300)] + ["", None, "long " * 9000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    want = {i: library(t) + [0] for i, t, _, _ in rows}
    for buffer in (5_000, 1_000_000):
        monkeypatch.setattr(pk, "BUFFER_TOKENS", buffer)
        got = [r.asDict() for r in pk.pack_documents(spark.createDataFrame(rows, DOCS).coalesce(2), with_ids=True).collect()]
        padding, _ = check_packing(got, want)
        assert padding < 2 * 1024 and all(r["ids"] == want[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in got)
    assert pk.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_tiers_and_step_groups():
    windows, rest = pk.pack_tiers(np.array([1, 5, 100, 129, 600, 1024, 2500, 300]))
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(s in pk.TIERS for s in sizes) and sum(sizes) + sum(p[2] for p in rest) == 4659
    groups = pk.balanced_groups([1024] * 100 + [128] * 80, 16_384)
    load = collections.Counter()
    for g, s in zip(groups, [1024] * 100 + [128] * 80):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 1024


def test_sentencepiece(spark, docs):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    rows = encode_pieces(docs, with_ids=True)
    got = sorted(((r["doc_id"] or -1, r["ids"], r["n_tokens"], r["ids_crc32"]) for r in rows.collect()), key=str)
    want = sorted(((r["doc_id"] or -1, i, len(i), crc(i)) for r in docs.collect() for i in [judge.encode(r["text"] or "")]), key=str)
    assert got == want and rows.filter("NOT parity OR NOT round_trip").count() == 0
    back = sorted(((r["doc_id"] or -1, r["text"]) for r in decode_pieces(rows).collect()), key=str)
    assert back == sorted(((r["doc_id"] or -1, r["text"] or "") for r in docs.collect()), key=str)
    assert encode_pieces(docs.limit(0)).count() == 0


def test_marker_characters_lose_the_round_trip_only():
    enc = encoder(tokenizer_path(MODEL), PieceEncoder)
    texts = pa.array(["▁x a▁b ▁", "plain words"])
    ids, at = enc.encode(texts)
    same, back = enc.verdicts(texts, ids, at)
    assert same.all() and back.tolist() == [False, True]


def test_model_file():
    model = read_model(tokenizer_path(MODEL))
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    assert model.model_type == BPE and model.byte_fallback and len(model.pieces) == judge.get_piece_size()
    assert all(p == judge.id_to_piece(i) and s == judge.get_score(i) for i, (p, s, _) in enumerate(model.pieces))
    rules = merge_rules(model)
    assert ("▁", "t") in rules and rules.index(("▁", "t")) < rules.index(("o", "m"))


def test_packed_bits_are_the_words_one_after_another():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 70, 3000):
        width = rng.integers(1, 18, n)
        words = np.array([int(rng.integers(0, 1 << int(w))) for w in width], dtype=np.uint64)
        want = "".join(f"{int(v):0{w}b}" for v, w in zip(words, width.tolist()))
        got = hf.pack_bits(words, width, np.cumsum(width) - width, len(want))
        assert "".join(f"{b:08b}" for b in got) == want + "0" * (-len(want) % 8)
