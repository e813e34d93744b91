"""The registered queries over whole tables: against SQL where there is some, else against brute force; and the pipeline."""

import os
import zlib

import duckdb
import pytest
from test_text_dedup import naive_lines, naive_near, naive_spans
from test_text_models import naive_base
from test_tokens import check_packing, crc

import __spark_entry__ as entry
import corpus_pipeline
from keeprank.llm import catalog
from keeprank.llm.bpe import DEFAULT_FILE, tokenizer_path
from keeprank.llm.sentencepieces import MODEL

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def rows_of(spark, key):
    return entry.queries()[key](spark, SF_DIR).collect()


def test_one_query_for_each_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, key):
    got = entry.queries()[key](spark, SF_DIR)
    cur = duck.execute(catalog.ORACLES[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_lattice_query(spark, texts):
    learned = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in texts}
    want = naive_base(list(texts.items()), learned)
    rows = rows_of(spark, "op1_lattice_likelihood")
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not learned[r["doc_id"]])
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0


def test_personal_data_query(spark, texts):
    for r in rows_of(spark, "op2_disclosure"):
        want = naive_spans(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:5]
        assert set(want[5].split(",")) <= set(r["spans"].split(","))


def test_token_queries(spark, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(DEFAULT_FILE))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    at, want = 0, []
    for i in sorted(ids):
        own = ids[i] + [2]
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert sorted(map(tuple, rows_of(spark, "op3_huffman_tokens"))) == want
    padding, sequences = check_packing([r.asDict() for r in rows_of(spark, "op7_hierarchical_packing")], {i: v + [0] for i, v in ids.items()})
    assert padding <= 0.02 * 1024 * sequences
    judge = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    own = {i: judge.encode(t or "") for i, t in texts.items()}
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op4_sentencepiece")) == sorted(
        (i, len(v), crc(v)) for i, v in own.items())


def test_toxicity_query(spark, texts):
    rows = rows_of(spark, "op5_toxicity")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_pipeline(spark, duck, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, texts
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs, before
        docs = stages[name](spark, docs, SF_DIR).cache()
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert len(after) == docs.count()
        was, before = before, after
        return was, after

    was, now = step("toxicity")
    clean = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    assert len(clean - set(now)) <= 0.05 * len(clean) and all(now[i] == was[i] for i in now)
    was, now = step("line_dedup")
    want = naive_lines(was.items())
    assert now == {i: want[i, t] for i, t in was.items() if want[i, t] or want[i, t] == t}
    was, now = step("near_duplicates")
    assert now == {r[0]: was[r[0]] for r in naive_near(list(was.items())) if r[4]}
    was, now = step("personal_data")
    assert set(now) == set(was) and not any(naive_spans(t)[5] for t in now.values() if t)
    assert all(now[i] == was[i] for i in was if not naive_spans(was[i])[5])
    pieces = sorted(tuple(r)[:5] for r in stages["packing"](spark, docs, SF_DIR).collect())
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert len({r["doc_id"] for r in whole}) == len(now) and sum(r["length"] for r in whole) == sum(p[2] for p in pieces)
