"""A corpus pipeline: toxic documents and documents of no certain language go, then near copies, then documents
with benchmark items; what stays is encoded.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept, and returns the columns of
``documents``; the last returns token digests. ``run`` writes every stage as Parquet in the shared folder and
reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relaylog.llm import byte_bpe, dart_minhash, decontaminate, language_id, toxicity_crf
from relaylog.llm.queries import table, token_digest, vocabulary
from relaylog.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones among them."""
    return toxicity_crf.keep_civil(docs, toxicity_crf.train(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    return language_id.keep_identified(docs, language_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return dart_minhash.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    return token_digest(byte_bpe.encode(docs, vocabulary(), decoded=True))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", encoding),
]

# Trained models and merges of byte pairs are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
