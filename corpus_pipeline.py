"""A corpus pipeline of four stages; each works on all that the one before kept.

Null and empty texts, null and repeated ids, and empty tables go through every
stage: a null text counts as an empty one, a row without an id is a document of
its own, columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import decontaminate, pieces, quality, simhash
from fabula.session import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores one half or more;
    each row is judged by itself, repeated ones alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least
    id. Null and empty texts are one group."""
    return simhash.keep_one(docs).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts
    hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again to prove the round trip; null and
    empty texts have none."""
    coded = pieces.encode_documents(docs)
    return coded.withColumn("decoded_chars", F.char_length("decoded")).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Learnt scores, tries and lattices are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
