"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes one run: its documents' digests, sorted, equal ones folded into one row. Then runs
``fan_in`` at a time meet in one round after another until one logical run is left (a binomial tree with wider nodes).
Each merge keeps, for a digest, the identifier that stays and the number of rows, and verifies that all that meet
under one digest agree in length and in a second, independent hash. The way back down hands each run its answers.
A digest that a third of all rows share reaches a merge as one row from each of at most ``fan_in`` runs, so no task
gathers a large group, neither on the way up nor down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import ascii_lower, staged, text_or_empty


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars, check, run): one row per document, sorted by digest inside each run."""
    text = ascii_lower(text_or_empty(text_col))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.spark_partition_id().alias("run"))
        .select(
            "id",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").alias("chars"),
            F.xxhash64("text").alias("check"),
            "run",
        )
        .sortWithinPartitions("digest")
    )


def merged(runs: DataFrame, fan_in: int, largest: bool) -> DataFrame:
    """One round: runs whose numbers share ``run div fan_in`` become one; the identifier that stays is verified."""
    pick = F.max if largest else F.min
    same = (F.col("lo_chars") == F.col("hi_chars")) & (F.col("lo_check") == F.col("hi_check"))
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("digest", "run")
        .agg(
            pick("keep").alias("keep"),
            F.sum("size").alias("size"),
            F.min("lo_chars").alias("lo_chars"),
            F.max("hi_chars").alias("hi_chars"),
            F.min("lo_check").alias("lo_check"),
            F.max("hi_check").alias("hi_check"),
        )
        # the length and the second hash of equal digests must agree, else the digests collided
        .withColumn("size", F.when(same, F.col("size")).otherwise(F.raise_error(F.lit("digest collision")).cast("long")))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 32, largest: bool = True
) -> DataFrame:
    """One row per document: its group of equal texts (A-Z lower-cased only) and the identifier that stays.

    Returns id_col, keep_id, group_size, kept, text_sha256. Null texts count as empty. A null identifier stays only if
    the whole group has none. Rows that repeat an identifier all count in group_size and share its ``kept``. An empty
    table gives no rows; other columns are ignored.
    """
    leaf = staged(digest_runs(docs, id_col, text_col), "digest-runs")
    last = leaf.agg(F.max("run")).first()[0]
    levels = [
        merged(
            leaf.select(
                "digest",
                "run",
                F.col("id").alias("keep"),
                F.lit(1).cast("long").alias("size"),
                F.col("chars").alias("lo_chars"),
                F.col("chars").alias("hi_chars"),
                F.col("check").alias("lo_check"),
                F.col("check").alias("hi_check"),
            ),
            1,
            largest,
        )
    ]
    while last:
        levels.append(merged(levels[-1], fan_in, largest))
        last //= fan_in
    answer = levels[-1].select("digest", F.col("run").alias("parent"), "keep", "size")
    for level in reversed(levels[:-1]):
        answer = (
            level.select("digest", "run", F.floor(F.col("run") / fan_in).cast("int").alias("parent"))
            .join(answer, ["digest", "parent"])
            .select("digest", F.col("run").alias("parent"), "keep", "size")
        )
    return leaf.join(answer.withColumnRenamed("parent", "run"), ["digest", "run"]).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
