"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import language_id, quality, token_store
from tidelake.llm.common import crc_mod, new_path, table
from tidelake.llm.decontaminate import contaminated
from tidelake.llm.exact_dedup import exact_dedup
from tidelake.llm.license_scan import license_scan
from tidelake.llm.line_dedup import line_dedup
from tidelake.llm.near_dedup import near_dedup
from tidelake.llm.piece_ops import round_trip
from tidelake.llm.token_counts import length_histogram, token_lengths


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_kept", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.verified(spark, folder)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return length_histogram(token_lengths(docs, tokenizer_path("word_bpe_49k.json")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.PuModel:
    """Positives: training rows of quality 1. Unlabelled: all documents, whose labels are not looked at."""
    train = labels.where((crc_mod("doc_id", 4) != 2) & (F.col("quality") == 1)).select("doc_id")
    return quality.fit(docs, train, docs.select("doc_id"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return language_id.predicted(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)
    """,
}
