"""Scan planning: which files to read and which deletes hold for them.

Manifests are decoded in tasks, one manifest at a time, into a frame of files; what is decided on single files (status,
pruning by bounds) happens there, and matching deletes to data files is a set of joins. Only small, pruned lists of
manifests are handled on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.deletes import DeleteError, normal_path
from tidelake.plans import interval
from tidelake.sources import files, manifests
from tidelake.sources.metadata import TableMetadata

FILES_SCHEMA = (
    "content int, file_path string, partition string, spec_id int, unpartitioned boolean, seq long, record_count long, "
    "file_size long, equality_ids array<int>, referenced_data_file string, content_offset long, content_size long, "
    "split_offsets array<long>, low_path string, high_path string"
)
#: Fixed value: field id of the path column in positional delete files.
PATH_FIELD = 2147483546
_PERIOD_US = {"hour": 3_600_000_000, "day": 86_400_000_000}
_DAY_US = 86_400_000_000


def _period_start(transform: str, n: int) -> int:
    """Days from 1970 to the start of a year or month."""
    from datetime import date

    year, month = (1970 + n, 1) if transform == "year" else (1970 + n // 12, n % 12 + 1)
    return (date(min(max(year, 1), 9999), month, 1) - date(1970, 1, 1)).days


def source_bounds(transform: str, kind: str, low: object, high: object, nulls: bool, only_nulls: bool) -> interval.Bounds:
    """Bounds of a source column from those of its partition values. timestamptz gets a day more on either side."""
    if only_nulls:
        return interval.Bounds(None, None, True, True)
    if low is None or high is None or transform not in ("identity", "year", "month", "day", "hour"):
        return interval.Bounds(None, None, nulls)
    if transform == "identity":
        return interval.Bounds(low, high, nulls)
    if transform in ("year", "month"):
        first, after = _period_start(transform, low), _period_start(transform, high + 1)
        if kind == "date":
            return interval.Bounds(first, after - 1, nulls)
        first, after = first * _DAY_US, after * _DAY_US
    else:
        if kind == "date":
            return interval.Bounds(low, high, nulls)
        first, after = low * _PERIOD_US[transform], (high + 1) * _PERIOD_US[transform]
    wider = _DAY_US if kind == "timestamptz" else 0
    return interval.Bounds(first - wider, after - 1 + wider, nulls)


def keep_manifest(row: dict, meta: TableMetadata, node) -> bool:
    """Whether a manifest may hold rows that pass the filter, by its partition summaries."""
    if node is None or not row.get("partitions"):
        return True
    by_id = {f["id"]: f for f in meta.schema_fields()}
    bounds: dict[str, interval.Bounds] = {}
    for part, s in zip(meta.spec(row["partition_spec_id"]), row["partitions"], strict=False):
        source = by_id.get(part["source-id"])
        if source is None or not isinstance(source["type"], str):
            continue
        kind = manifests.partition_type(part["transform"], source["type"])
        low, high = (manifests.bound_value(kind, s[k]) for k in ("lower_bound", "upper_bound"))
        nothing = low is None and s["contains_null"]
        bounds[source["name"]] = source_bounds(part["transform"], source["type"], low, high, s["contains_null"], nothing)
    return interval.evaluate(node, bounds) is not interval.Match.NONE


def keep_manifests(rows: Iterable[dict], meta: TableMetadata, node) -> list[bool]:
    return [keep_manifest(r, meta, node) for r in rows]


def keep_file(file: dict, fields: dict[int, dict], node) -> bool:
    """Whether a data file may hold rows that pass the filter, by its columns' bounds. Bounds of floats aren't used."""
    if node is None:
        return True
    bounds = {}
    for i, f in fields.items():
        if not isinstance(f["type"], str) or f["type"] in ("float", "double"):
            continue
        nulls, values = (file.get("null_value_counts") or {}).get(i), (file.get("value_counts") or {}).get(i)
        low, high = (manifests.bound_value(f["type"], (file.get(k) or {}).get(i)) for k in ("lower_bounds", "upper_bounds"))
        only = nulls is not None and values is not None and nulls == values
        bounds[f["name"]] = interval.Bounds(low, high, nulls is None or nulls > 0, only)
    return interval.evaluate(node, bounds) is not interval.Match.NONE


def _plain(v: object) -> object:
    return v.hex() if isinstance(v, bytes) else str(v) if isinstance(v, Decimal) else v


def partition_key(spec_id: int, values: dict) -> str:
    """One text for a partition: its spec and named values; equal partitions have equal texts."""
    return json.dumps([spec_id if values else -1, sorted((k, _plain(v)) for k, v in values.items())], default=str)


def file_rows(manifest: dict, data: bytes, fields: dict[int, dict], specs: dict[int, list[str]], node) -> Iterable[tuple]:
    """Live entries of a manifest as rows of FILES_SCHEMA: sequence numbers are inherited, deleted entries left out."""
    skip = frozenset({"column_sizes", "nan_value_counts"} | (set() if node is not None or manifest["content"] else {"value_counts", "null_value_counts"}))
    for e in manifests.read_manifest(data, skip):
        if e["status"] == manifests.DELETED:
            continue
        seq = e["sequence_number"]
        if seq is None:
            if e["status"] != manifests.ADDED:
                raise ValueError("an entry that isn't new has no sequence number")
            seq = manifest["sequence_number"]
        f = e["data_file"]
        fitting = [s for s, names in specs.items() if set(names) == set(f["partition"])]
        if manifest["partition_spec_id"] not in fitting:
            raise ValueError(f"the partition of {f['file_path']} doesn't fit its spec")
        if f["content"] == manifests.DATA and not keep_file(f, fields, node):
            continue
        low, high = ((f.get(k) or {}).get(PATH_FIELD) for k in ("lower_bounds", "upper_bounds"))
        yield (
            f["content"], f["file_path"], partition_key(manifest["partition_spec_id"], f["partition"]), manifest["partition_spec_id"],
            not f["partition"], seq, f["record_count"], f["file_size_in_bytes"], f.get("equality_ids"), f.get("referenced_data_file"),
            f.get("content_offset"), f.get("content_size_in_bytes"), f.get("split_offsets"),
            low.decode() if low else None, high.decode() if high else None,
        )


def plan_files(spark: SparkSession, meta: TableMetadata, snapshot: dict | None, node=None) -> DataFrame:
    """All files of a snapshot that a scan with this filter needs, data and deletes, as a frame."""
    if snapshot is None:
        return spark.createDataFrame([], FILES_SCHEMA)
    listed = manifests.read_list(files.read_bytes(spark, snapshot["manifest-list"]))
    kept = [m for m in listed if m["content"] != manifests.DATA or keep_manifest(m, meta, node)]
    if not kept:
        return spark.createDataFrame([], FILES_SCHEMA)
    by_path = {normal(m["manifest_path"]): {k: v for k, v in m.items() if k != "partitions"} for m in kept}
    fields = {f["id"]: f for f in meta.schema_fields()}
    specs = {s["spec-id"]: [f["name"] for f in s["fields"]] for s in meta.raw["partition-specs"]}

    def decode(rows):
        import pandas as pd

        names = [c.split()[0] for c in FILES_SCHEMA.split(", ")]
        for frame in rows:
            for path, content in zip(frame.path, frame.content, strict=True):
                out = list(file_rows(by_path[normal(path)], bytes(content), fields, specs, node))
                if out:
                    yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    raw = spark.read.format("binaryFile").load([m["manifest_path"] for m in kept]).select("path", "content")
    return raw.mapInPandas(decode, FILES_SCHEMA)


def normal(path: str) -> str:
    import re

    return re.sub("^file:/+", "/", path)


def attached(plan: DataFrame) -> DataFrame:
    """Data files with what deletes them: vector (offset, size, path), positional and equality delete files.

    Deletion vectors: the newest of a file, if not older than it. Positional deletes: same partition, not older, and
    the file's path inside the deletes' path bounds or named by them. Equality deletes: strictly newer, same partition
    or unpartitioned. A vector and other deletes of one file's layer contradict each other.
    """
    data = plan.where("content = 0").select("file_path", "partition", "seq", "record_count", normal_path(F.col("file_path")).alias("p"))
    vector = F.col("content_offset").isNotNull()
    dv = (
        plan.where((F.col("content") == 1) & vector)
        .groupBy(normal_path(F.col("referenced_data_file")).alias("p"))
        .agg(F.max_by(F.struct("seq", "content_offset", "content_size", F.col("file_path").alias("path")), "seq").alias("vector"))
    )
    pos = plan.where((F.col("content") == 1) & ~vector).select(
        F.col("partition").alias("d_part"), F.col("seq").alias("d_seq"), F.col("file_path").alias("d_file"),
        normal_path(F.col("low_path")).alias("low"), normal_path(F.col("high_path")).alias("high"),
        normal_path(F.col("referenced_data_file")).alias("named"),
    )
    eq = plan.where("content = 2").select(
        F.col("partition").alias("d_part"), F.col("seq").alias("d_seq"), F.col("file_path").alias("d_file"), "equality_ids", "unpartitioned"
    )
    inside = (F.col("named").isNull() | (F.col("named") == F.col("p"))) & (
        F.col("low").isNull() | ((F.col("low") <= F.col("p")) & (F.col("p") <= F.col("high")))
    )
    with_pos = (
        data.join(pos, (F.col("partition") == F.col("d_part")) & (F.col("d_seq") >= F.col("seq")) & inside)
        .groupBy("file_path")
        .agg(F.collect_set("d_file").alias("positional"), F.max(F.col("d_seq") == F.col("seq")).alias("same_layer"))
    )
    same = eq.where("NOT unpartitioned")
    everywhere = eq.where("unpartitioned")
    own = data.join(same, (F.col("partition") == F.col("d_part")) & (F.col("d_seq") > F.col("seq"))).select("file_path", "d_file", "equality_ids")
    # unpartitioned equality deletes hold for every older data file, whatever its partition
    wide = data.join(everywhere, F.col("d_seq") > F.col("seq")).select("file_path", "d_file", "equality_ids")
    with_eq = own.union(wide).groupBy("file_path").agg(F.collect_set(F.struct("d_file", "equality_ids")).alias("equality"))
    out = (
        data.join(dv.withColumnRenamed("p", "v_p"), (F.col("p") == F.col("v_p")) & (F.col("seq") <= F.col("vector.seq")), "left")
        .join(with_pos, "file_path", "left")
        .join(with_eq, "file_path", "left")
    )
    clash = F.col("vector").isNotNull() & (F.col("positional").isNotNull() | F.col("equality").isNotNull())
    message = F.concat(F.lit("deletion vector and other deletes for "), F.col("file_path"))
    return out.select(
        "file_path", "partition", F.when(clash, F.raise_error(message).cast("bigint")).otherwise(F.col("seq")).alias("seq"), "record_count", "vector",
        "positional", "equality",
    )


def dangling_positional(plan: DataFrame) -> DataFrame:
    """Positional delete files with path bounds in which no data file lies (of the same partition, not newer)."""
    data = plan.where("content = 0").select(F.col("partition").alias("part"), F.col("seq").alias("data_seq"), normal_path(F.col("file_path")).alias("p"))
    pos = plan.where("content = 1 AND content_offset IS NULL AND low_path IS NOT NULL")
    on = (
        (F.col("partition") == F.col("part")) & (F.col("data_seq") <= F.col("seq"))
        & (F.col("p") >= normal_path(F.col("low_path"))) & (F.col("p") <= normal_path(F.col("high_path")))
    )
    return pos.join(data, on, "left_anti").select("file_path")


def dangling_vectors(plan: DataFrame) -> DataFrame:
    """Deletion vectors of files that the plan doesn't read."""
    data = plan.where("content = 0").select(normal_path(F.col("file_path")).alias("p"))
    vectors = plan.where("content = 1 AND content_offset IS NOT NULL")
    return vectors.join(data, normal_path(F.col("referenced_data_file")) == F.col("p"), "left_anti").select("file_path", "referenced_data_file")


def summary(plan: DataFrame) -> DataFrame:
    """Counts of a plan: data files, positional and equality deletes, vectors, partitions."""
    return plan.agg(
        F.count_if(F.col("content") == 0).alias("data_files"),
        F.count_if((F.col("content") == 1) & F.col("content_offset").isNull()).alias("positional_deletes"),
        F.count_if(F.col("content") == 2).alias("equality_deletes"),
        F.count_if(F.col("content_offset").isNotNull()).alias("deletion_vectors"),
        F.count_distinct("partition").alias("partitions"),
    )


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    """Whether two plans have the same files, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merged_segments(segments: DataFrame) -> DataFrame:
    """Union of byte ranges (path, offset, length) of each file; length 0 reaches to the end of the file."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("offset", "end")
    end: Column = F.when(F.col("length") == 0, F.lit(2**63 - 1)).otherwise(F.col("offset") + F.col("length"))
    marked = segments.withColumn("end", end).withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("starts", (F.col("before").isNull() | (F.col("offset") > F.col("before"))).cast("int"))
    grouped = marked.withColumn("g", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("path", "g")
    out = grouped.agg(F.min("offset").alias("offset"), F.max("end").alias("end"))
    return out.select("path", "offset", F.when(F.col("end") == 2**63 - 1, 0).otherwise(F.col("end") - F.col("offset")).alias("length"))


__all__ = ["DeleteError", "attached", "dangling_positional", "dangling_vectors", "keep_file", "keep_manifests", "merged_segments", "plan_files", "same_plan", "source_bounds", "summary"]
