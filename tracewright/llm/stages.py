"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is taken out, sources are mixed to their
weights and the mix is encoded. Each stage is a function of (spark, docs, sf_dir); ``run`` writes each result and reads it back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, pii, simhash, toxicity
from .common import fold, read_table, written
from .registry import VOCABULARY


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The machine is trained on labelled rows of the documents table (crc32(doc_id) mod 5 not 0)."""
    machine = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, machine).where("score < 0.5").select(docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with similar five-word shingles (0.8 or more) the one with the smallest id."""
    return simhash.dedup(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced by their kind; n_chars follows the text. A null text stays null."""
    out = pii.sanitised(docs).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    n = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each document."""
    return bpe.encode(docs, VOCABULARY).select("doc_id", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", toxic_out), ("simhash_near_dedup", near_duplicates_out), ("pii", personal_data_out), ("mix_sources", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Kernel machines, component search and tokenizing have no SQL form; the operators are held against brute force in tests/llm, the chain of stages in tests/llm/test_pipeline.py.
ORACLE_SQL = None
