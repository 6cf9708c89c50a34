"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, then token ids.

Each stage takes the documents its predecessor kept and returns the same columns; the last one returns digests of the
encoded and decoded texts. Stages are written as tables and read back in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import quality
from tidelake.llm.common import ascii_lower, staged, table, text_or_empty
from tidelake.llm.decontaminate import contaminated
from tidelake.llm.exact_dedup import exact_dedup
from tidelake.llm.links import looked_up
from tidelake.llm.near_dedup import near_dedup
from tidelake.llm.piece_ops import round_trip
from tidelake.llm.queries import quality_model, tokenizer_path

#: Texts of a lower score are rejected; below the even score a text is likelier junk than not.
LEAST_QUALITY = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose ids aren't in gone. Rows without an id stay: no id can name them."""
    return looked_up(docs, staged(gone.select("doc_id").distinct(), "gone"), "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go, null and empty ones by their score as any other; each row by itself."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_of(model, F.col("text")) >= LEAST_QUALITY)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the document with the largest id stays, one row of it if rows repeat it.

    Of a group in which no row has an id one row stays. Where rows of different texts repeat an id, each text counts as
    a document of its own.
    """
    found = staged(exact_dedup(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "kept")
    # ids that are all a document needs to be told by: those whose rows are alike, and one
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept"))
    odd = staged(rows.where("n > 1 OR doc_id IS NULL").select("doc_id"), "odd")
    kept = _without(docs, rows.where("NOT kept AND n = 1"))
    if odd.isEmpty():
        return kept
    told = kept.withColumn("_digest", F.unhex(F.sha2(ascii_lower(text_or_empty("text")), 256)))
    single = told.join(odd.withColumnRenamed("doc_id", "_odd"), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_anti")
    several = told.join(odd.withColumnRenamed("doc_id", "_odd"), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")
    stay = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")).distinct()
    several = several.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "_digest"])).drop("_digest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at a similarity of 0.8 the document with the smallest id stays.

    Rows that repeat an id go together, if any of them isn't kept; rows without an id stay. Texts without words stay.
    """
    return _without(docs, near_dedup(docs, percent=80).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; rows without an id stay."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and digests of every row, null and empty texts included; other columns are dropped."""
    return round_trip(docs, tokenizer_path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Fitted models, MinHash and SimHash have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
