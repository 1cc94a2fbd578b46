"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import alignment, decontaminate, embedding_dedup, hard_negatives, host_rules, htmltext, katz, pieces, quality, sharding, simhash, training_order, warc
from fabula.session import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.written_shards(table(spark, sf_dir, "documents"), shards=16))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and of the text decoded from them its length,
    checksum and whether it is the document's."""
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", "n_tokens", "token_ids", "n_chunks", F.char_length("decoded").alias("decoded_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "round_trip"
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.digest(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.SQL, "op11_host_rules": host_rules.SQL, "op13_hard_negatives": hard_negatives.SQL}
