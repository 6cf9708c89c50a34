"""Row-level deletes as anti-joins: positional deletes, equality deletes, deletion vectors.

Data rows carry file_path, row position, sequence number and partition key as columns (see sources.table). All three
are left-anti joins that Spark plans itself: small delete sets are broadcast below Spark's own threshold, others are
shuffled, and adaptive execution splits skewed files. Delete sets are reduced to one row per key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, POS, SEQ, PART = "_file", "_pos", "_seq", "_partition"


class DeleteError(ValueError):
    """Delete files that contradict the table's rules."""


def normal_path(path: Column) -> Column:
    """file:///a, file:/a and /a name one file."""
    return F.regexp_replace(path, "^file:/+", "/")


def check_positional_schema(schema: T.StructType) -> None:
    """Positional delete files have (path string, position long) and may have the row as a third column."""
    kinds = [f.dataType for f in schema.fields]
    if len(kinds) not in (2, 3) or not isinstance(kinds[0], T.StringType) or not isinstance(kinds[1], T.LongType):
        raise DeleteError(f"not a positional delete file: {schema.simpleString()}")


def positional(data: DataFrame, deletes: DataFrame, path: str = FILE, pos: str = POS) -> DataFrame:
    """Rows whose (file, position) isn't deleted. deletes: file_path, pos and, if the table is layered, seq, partition.

    A delete holds for files of its own partition whose sequence number is at most its own.
    """
    keys = deletes.select(
        normal_path(F.col("file_path")).alias("d_path"),
        F.col("pos").alias("d_pos"),
        *([F.col("seq").alias("d_seq")] if "seq" in deletes.columns else []),
        *([F.col("partition").alias("d_part")] if "partition" in deletes.columns else []),
    )
    on = (normal_path(F.col(path)) == F.col("d_path")) & (F.col(pos) == F.col("d_pos"))
    group = ["d_path", "d_pos"]
    if "d_part" in keys.columns:
        on &= F.col(PART).eqNullSafe(F.col("d_part"))
        group.append("d_part")
    if "d_seq" in keys.columns:
        on &= F.col("d_seq") >= F.col(SEQ)
        keys = keys.groupBy(*group).agg(F.max("d_seq").alias("d_seq"))
    else:
        keys = keys.distinct()
    return data.join(keys, on, "left_anti")


def equality(data: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that equal no delete in all key columns; null equals null.

    With a seq column, a delete holds for rows of strictly smaller sequence numbers; with a partition column, for rows
    of its partition, a null partition standing for all (unpartitioned deletes are global).
    """
    if not keys:
        raise DeleteError("an equality delete needs a column")
    layered, parted = "seq" in deletes.columns, "partition" in deletes.columns
    named = deletes.select(
        *(F.col(k).alias(f"d_{i}") for i, k in enumerate(keys)),
        *([F.col("seq").alias("d_seq")] if layered else []),
        *([F.col("partition").alias("d_part")] if parted else []),
    )
    group = [f"d_{i}" for i in range(len(keys))] + ["d_part"] * parted
    named = named.groupBy(*group).agg(F.max("d_seq").alias("d_seq")) if layered else named.distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"d_{i}"))
    if layered:
        on &= F.col("d_seq") > F.col(SEQ)
    if parted:
        on &= F.col("d_part").isNull() | F.col(PART).eqNullSafe(F.col("d_part"))
    return data.join(named, on, "left_anti")


def equality_sets(data: DataFrame, deletes: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Several delete sets, each with its own key columns: one anti-join for each set of columns."""
    by_keys: dict[tuple[str, ...], DataFrame] = {}
    for keys, frame in deletes:
        k = tuple(sorted(keys))
        frame = frame.select(*k, *(c for c in ("seq", "partition") if c in frame.columns))
        by_keys[k] = by_keys[k].unionByName(frame, allowMissingColumns=True) if k in by_keys else frame
    for keys, frame in by_keys.items():
        data = equality(data, frame, keys)
    return data


def newest_vectors(vectors: DataFrame) -> DataFrame:
    """One deletion vector for each data file: that of the largest sequence number. vectors: file_path, seq, ..."""
    others = [c for c in vectors.columns if c != "file_path"]
    newest = vectors.groupBy("file_path").agg(F.max_by(F.struct(*others), "seq").alias("v"))
    return newest.select("file_path", "v.*")


def deletion_vectors(data: DataFrame, vectors: DataFrame, path: str = FILE, pos: str = POS) -> DataFrame:
    """Rows that the newest vector of their file doesn't hold. vectors: file_path, seq, positions array<long>.

    A vector holds for files whose sequence number is at most its own; without a _seq column for all.
    """
    rows = newest_vectors(vectors).select(
        normal_path(F.col("file_path")).alias("d_path"), F.col("seq").alias("d_seq"), F.explode("positions").alias("d_pos")
    )
    on = (normal_path(F.col(path)) == F.col("d_path")) & (F.col(pos) == F.col("d_pos"))
    if SEQ in data.columns:
        on &= F.col(SEQ) <= F.col("d_seq")
    return data.join(rows, on, "left_anti")


def checked_layers(files: DataFrame) -> DataFrame:
    """Fails when a deletion vector and other deletes share a data file's layer. files: file_path, has_vector, has_deletes."""
    clash = F.col("has_vector") & F.col("has_deletes")
    message = F.concat(F.lit("deletion vector and other deletes in one layer: "), F.col("file_path"))
    return files.withColumn("has_vector", F.when(clash, F.raise_error(message).cast("boolean")).otherwise(F.col("has_vector")))
