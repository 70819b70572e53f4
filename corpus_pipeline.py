"""Five stages from raw documents to token ids, each by one operator of ``evispark.llm``.

Every stage's result is written as Parquet into the shared folder and read again as the
next one's documents, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import bpe, decontaminate, langid, secret_scan, simhash
from evispark.llm.common import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fit no learned language; models are learned from the labelled documents."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least identifier, of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; n_chars follows the text."""
    ratio = secret_scan.train(secret_scan.labelled_tokens(docs))
    return secret_scan.redact(docs, ratio).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids and n_tokens; raises if a text does not decode to itself."""
    return bpe.round_trip(docs, docs.columns)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", secrets_redacted),
    ("bpe", tokenized),
]

#: The stages' models and embeddings can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
