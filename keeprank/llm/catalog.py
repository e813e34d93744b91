"""One query per operator over its whole table, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keeprank.llm.cross_polytope import nearest
from keeprank.llm.disclosure import personal_data
from keeprank.llm.forest import near_duplicates
from keeprank.llm.huffman import token_file_digest
from keeprank.llm.lattice import lattice_scores
from keeprank.llm.line_chunks import drop_repeated_chunks
from keeprank.llm.maxscore import rank_documents
from keeprank.llm.near_vectors import near_vectors
from keeprank.llm.packing import pack_documents
from keeprank.llm.piece_table import fill_in_middle
from keeprank.llm.sentencepieces import encode_pieces
from keeprank.llm.topk import exact_top_k
from keeprank.llm.toxicity import toxicity_scores
from keeprank.llm.vectors import read_embeddings
from keeprank.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_lattice_likelihood")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 is not 1."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = lattice_scores(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_disclosure")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query("op3_huffman_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), pin_utc(spark).read.parquet(f"{sf_dir}/labels.parquet"))


@query("op6_lsh_forest", """
WITH RECURSIVE words AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), piece AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM piece a JOIN piece b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (SELECT a, b, c = na AND c = nb AS same FROM shared WHERE c >= 0.8 * (na + nb - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), head AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), own AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM documents JOIN head ON doc_id = head.a LEFT JOIN own ON doc_id = own.a
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query("op7_hierarchical_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


@query("op8_line_chunks", """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(l), 1, 8) AS BIGINT) AS h, length(l) - length(replace(l, ' ', '')) + 1 AS w FROM line
), ended AS (
  SELECT *, coalesce(lead(w) OVER d >= 50, true) OR w >= 50 OR (coalesce(lag(h) OVER d, 0) * 1000003 + h) % 3 = 0 AS cut
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) - CAST(cut AS INTEGER) AS c FROM ended
), chunk AS (
  SELECT doc_id, c, string_agg(l, chr(10) ORDER BY i) AS body, count(*) AS size, sum(w) AS words FROM numbered GROUP BY doc_id, c
), ranked AS (
  SELECT *, words >= 20 AND (size >= 2 OR words >= 50) AND row_number() OVER (PARTITION BY body ORDER BY doc_id, c) > 1 AS gone
  FROM chunk
), pair AS (
  SELECT doc_id, i, w, lead(w) OVER d AS w2, l || chr(10) || lead(l) OVER d AS body FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM pair WHERE body IS NOT NULL) WHERE nth > 1
), gone AS (
  SELECT doc_id, unnest(range(min(i), max(i) + 2)) AS i FROM later GROUP BY doc_id, run HAVING arg_min(w, i) + sum(w2) >= 50
  UNION SELECT doc_id, i FROM numbered JOIN ranked USING (doc_id, c) WHERE gone
), marked AS (
  SELECT line.*, gone.i IS NOT NULL AS gone FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i
)
SELECT doc_id, count(*) AS lines_before, count(*) FILTER (gone) AS lines_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"), counts=True, drop_emptied=False)
    return cleaned.select("doc_id", "lines_before", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op9_near_vectors", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN least_id ON e.vec_id = least_id.a
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_embeddings(spark, sf_dir))


@query("op10_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)


@query("op11_pair_maxscore", r"""
WITH dt AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), g AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM dt
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM dt)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM g) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * (SELECT docs FROM g)) // (SELECT terms FROM g))))) AS BIGINT) AS score
  FROM it JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_cross_polytope")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


@query("op13_piece_table", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256(concat('1:', doc_id)) AS h FROM documents
), d AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir))
