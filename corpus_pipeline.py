"""Five stages from raw documents to packed training sequences, each a pass over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keeprank.llm.disclosure import sanitise
from keeprank.llm.forest import one_per_group
from keeprank.llm.line_chunks import drop_repeated_chunks
from keeprank.llm.packing import pack_documents
from keeprank.llm.storage import put
from keeprank.llm.toxicity import drop_toxic
from keeprank.session import pin_utc, scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, rejects go; without labelled documents none does."""
    return drop_toxic(docs, pin_utc(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand in an earlier document go; a document left without a line goes too."""
    return drop_repeated_chunks(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and terms that disclose it are generalised or removed."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens, with their ids."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

# A classifier, hashed signatures and a tokenizer: not SQL. tests/llm runs the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = pin_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = put(stage(spark, docs, sf_dir), scratch_path(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
