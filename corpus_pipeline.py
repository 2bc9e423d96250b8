"""The corpus pipeline: toxic documents go, near-duplicates go, personal data is generalised,
sources are mixed to their target weights, and what is left becomes token ids.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents; the last gives doc_id, ids (packed little-endian unsigned 32-bit), n_tokens and
decoded_sha256, a digest of what decoding the ids gives.

Stages take null ids and texts, empty texts and repeated rows as their operators do. A document that
the mix repeats has a row for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brinewave.llm import bpe, mixing, sanitising, simhash, toxicity
from brinewave.session import cut_lineage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from the documents at hand that have labels."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash over five-word shingles."""
    return simhash.kept_documents(docs, width=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it give way to their kind in brackets."""
    return sanitising.sanitised(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source as its weight asks, at most three times each."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), raw="decoded")
    count = F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens")
    return coded.select("doc_id", "ids", count, F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: Trained scores, XXH64 and BPE are beyond SQL; the tests have a plainer form of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
