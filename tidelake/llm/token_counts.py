"""Exact length histogram: documents counted by encoded length, then suffix sums for every context limit.

The histogram has one row per distinct length. Running sums over it give, for a limit L that equals a length, the
documents that fit and that do not, the total of tokens, the total after truncation to L, and the share of documents
of at most L tokens (whose inverse is the exact quantile function). Between two lengths the truncated total is linear
in L, so ``truncated_total`` answers any limit from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import map_texts
from tidelake.llm.tokenizers_io import encoder


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) of every whole text; null and empty texts have 0."""

    def rows():
        encode = encoder(path).all_ids
        return lambda ids, texts: {"id": ids, "n_tokens": [len(x) // 4 for x in encode(texts)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, rows, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length, with prefix and suffix sums.

    The windows run in one task over distinct lengths, whose number is bounded by the longest document, not by the
    number of documents. Null lengths are left out; an empty table gives no rows.
    """
    counts = (
        lengths.where(F.col(length_col).isNotNull())
        .groupBy(F.col(length_col).cast("long").alias("n_tokens"))
        .agg(F.count("*").alias("n_docs"))
    )
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        counts.withColumn("docs_at_most", F.sum("n_docs").over(up))
        .withColumn("tokens_at_most", F.sum(tokens).over(up))
        .withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(down), F.lit(0)))
        .withColumn("tokens_longer", F.coalesce(F.sum(tokens).over(down), F.lit(0)))
        .withColumn("truncated_total", F.col("tokens_at_most") + F.col("docs_longer") * F.col("n_tokens"))
        .withColumn("quantile", F.col("docs_at_most") / F.sum("n_docs").over(everything))
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column | int:
    """Tokens left when every document is cut to ``limit`` tokens."""
    return histogram.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))).first()[0] or 0


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length of which at least the share q of documents is no longer."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]
