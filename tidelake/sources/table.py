"""Snapshot tables on a file system: create, append, delete files, commits, time travel, reads.

Rows are written and read by Spark; the driver only handles metadata and manifests. A commit writes the manifest, the
manifest list and the next metadata file, and takes effect by a rename that fails if another writer was first.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import transforms
from tidelake.operators import deletes
from tidelake.plans import filters, planning
from tidelake.sources import files, manifests, puffin, roaring
from tidelake.sources import schema as S
from tidelake.sources.metadata import MetadataError, TableMetadata, new_metadata


class CommitError(RuntimeError):
    """Another writer committed first, or the transaction is over."""


class Table:
    def __init__(self, spark: SparkSession, metadata_location: str, meta: TableMetadata):
        self.spark, self.metadata_location, self.meta = spark, metadata_location, meta

    # ---- opening and creating

    @staticmethod
    def open(spark: SparkSession, location: str) -> Table:
        """A table by its metadata file, or by its folder, where the newest metadata file counts."""
        if not location.endswith(".json"):
            found = [p for p, _ in files.listed(spark, f"{location}/metadata") if p.endswith(".metadata.json")]
            if not found:
                raise MetadataError(f"no table at {location}")
            location = max(found, key=lambda p: int(re.match(r"v?(\d+)", p.rsplit("/", 1)[1])[1]))
        return Table(spark, location, TableMetadata.from_json(files.read_bytes(spark, location)))

    @staticmethod
    def create(spark: SparkSession, location: str, schema: T.StructType, spec: Sequence[tuple[str, str]] = (), properties: dict | None = None) -> Table:
        meta = new_metadata(location, schema, list(spec), properties)
        path = f"{location}/metadata/00000-{uuid.uuid4()}.metadata.json"
        files.write_bytes(spark, path, meta.to_json().encode())
        return Table(spark, path, meta)

    @property
    def schema(self) -> T.StructType:
        from tidelake.sources.metadata import spark_schema

        return spark_schema(self.meta.schema_fields())

    # ---- writing

    def _partitioned(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        by_id = {f["id"]: f["name"] for f in self.meta.schema_fields()}
        names = []
        for p in self.meta.spec():
            source = by_id[p["source-id"]]
            df = df.withColumn(f"_p_{p['name']}", transforms.apply(p["transform"], F.col(source), df.schema[source].dataType))
            names.append(f"_p_{p['name']}")
        return df, names

    def _write_files(self, df: DataFrame, kind: str, partitioned: bool = True) -> list[dict]:
        """Parquet files below data/, one folder for each partition, and their entries with counts and bounds."""
        folder = f"{self.meta.location}/data/{kind}-{uuid.uuid4()}"
        ids = self._ids()
        df = df.select(*(F.col(f"`{c}`").alias(c, metadata={S.FIELD_ID: ids[c][0]}) for c in df.columns))
        parts: list[str] = []
        if partitioned:
            df, parts = self._partitioned(df)
        # files of one partition come from few tasks; adaptive execution splits partitions that are too large
        out = df.hint("rebalance", *parts) if parts else df
        (out.write.partitionBy(*parts) if parts else out.write).parquet(folder)
        return self._entries(folder, parts, df)

    def _ids(self) -> dict[str, tuple[int, object]]:
        """Field ids and types by name; the two columns of positional deletes have ids of the format's own."""
        own = {f["name"]: (f["id"], f["type"]) for f in self.meta.schema_fields()}
        return {"file_path": (planning.PATH_FIELD, "string"), "pos": (2147483545, "long")} | own

    def _entries(self, folder: str, parts: list[str], df: DataFrame) -> list[dict]:
        plain = [f for f in df.schema.fields if f.name not in parts]
        ids = self._ids()
        measured = [f for f in plain if f.name in ids and isinstance(ids[f.name][1], str) and not isinstance(f.dataType, (T.BinaryType, T.ArrayType))]
        schema = T.StructType([*plain, *(T.StructField(p, df.schema[p].dataType) for p in parts)])
        raw = self.spark.read.schema(schema).parquet(folder)
        # a set among the aggregates makes Spark hash the files; for bounds of strings it would sort all rows by their path
        aggs = [F.count("*").alias("n"), F.get(F.collect_set("_size"), F.lit(0)).alias("size"), *(F.first(p).alias(p) for p in parts)]
        for i, f in enumerate(measured):
            aggs += [F.min(f.name).alias(f"lo_{i}"), F.max(f.name).alias(f"hi_{i}"), F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"null_{i}")]
        rows = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")).groupBy("_path").agg(*aggs).collect()
        spec = self.meta.spec()
        sources = {f["id"]: f["type"] for f in self.meta.schema_fields()}
        out = []
        for r in rows:
            low, high, nulls, values = {}, {}, {}, {}
            for i, f in enumerate(measured):
                fid, kind = ids[f.name]
                if r[f"lo_{i}"] is not None:
                    low[fid], high[fid] = manifests.bound_bytes(kind, r[f"lo_{i}"]), manifests.bound_bytes(kind, r[f"hi_{i}"])
                nulls[fid], values[fid] = r[f"null_{i}"], r["n"]
            partition = {}
            for p in spec if parts else []:
                kind = manifests.partition_type(p["transform"], sources[p["source-id"]])
                v = r[f"_p_{p['name']}"]
                partition[p["name"]] = manifests.plain(kind, v) if kind in manifests._AVRO_TYPES or v is None else str(v)
            file = {
                "content": manifests.DATA, "file_path": r["_path"], "file_format": "PARQUET", "partition": partition, "record_count": r["n"],
                "file_size_in_bytes": r["size"], "value_counts": values, "null_value_counts": nulls, "lower_bounds": low, "upper_bounds": high,
                "split_offsets": [4],
            }
            out.append({"status": manifests.ADDED, "data_file": file})
        return out

    def append(self, df: DataFrame, ref: str = "main") -> Table:
        """Append rows: the frame's columns are taken by name."""
        names = [f["name"] for f in self.meta.schema_fields()]
        return self.transaction().add(self._write_files(df.select(*names), "append")).commit(ref)

    def delete_positions(self, positions: DataFrame, ref: str = "main") -> Table:
        """Positional deletes: frame of (file_path, pos), written sorted by both, each under its data file's partition.

        Positions of files that the table's snapshot doesn't have delete nothing and aren't written.
        """
        deletes.check_positional_schema(positions.schema)
        rows = positions.select("file_path", "pos")
        if not self.meta.spec():
            rows = rows.repartitionByRange("file_path", "pos").sortWithinPartitions("file_path", "pos")
            entries = self._write_files(rows, "positions", partitioned=False)
            return self.transaction().add(self._as_deletes(entries, manifests.POSITION_DELETES)).commit(ref)
        data = self.plan(ref=ref).where("content = 0").select(
            deletes.normal_path(F.col("file_path")).alias("p"), "partition", "spec_id", F.xxhash64("partition").alias("_part")
        )
        rows = rows.join(data, deletes.normal_path(F.col("file_path")) == F.col("p"))
        touched = {r._part: (r.spec_id, r.partition) for r in rows.select("_part", "spec_id", "partition").distinct().collect()}
        folder, ids = f"{self.meta.location}/data/positions-{uuid.uuid4()}", self._ids()
        rows = rows.select(*(F.col(c).alias(c, metadata={S.FIELD_ID: ids[c][0]}) for c in ("file_path", "pos")), "_part")
        rows = rows.repartitionByRange("_part", "file_path", "pos").sortWithinPartitions("_part", "file_path", "pos")
        rows.write.partitionBy("_part").parquet(folder)
        entries = []
        for e in self._entries(folder, [], rows.drop("_part")) if touched else []:
            spec_id, text = touched[int(re.search(r"/_part=(-?\d+)/", e["data_file"]["file_path"])[1])]
            file = e["data_file"] | {"content": manifests.POSITION_DELETES, "equality_ids": None, "partition": self._partition_values(spec_id, text)}
            entries.append(e | {"data_file": file, "spec_id": spec_id})
        return self.transaction().add(entries).commit(ref)

    def _partition_values(self, spec_id: int, text: str) -> dict:
        """The values that a plan's partition text names, in the types in which manifests hold them."""
        sources = {f["id"]: f["type"] for f in self.meta.schema_fields()}
        spec = next(s["fields"] for s in self.meta.raw["partition-specs"] if s["spec-id"] == spec_id)
        kinds = {p["name"]: manifests.partition_type(p["transform"], sources[p["source-id"]]) for p in spec}
        return {k: v if v is None or kinds[k] in manifests._AVRO_TYPES else str(v) for k, v in json.loads(text)[1]}

    def delete_equal(self, keys: DataFrame, ref: str = "main") -> Table:
        """Equality deletes on the frame's columns, for every older row whatever its partition."""
        ids = [self.meta.find_field(c)["id"] for c in keys.columns]
        entries = self._write_files(keys, "equal", partitioned=False)
        return self.transaction().add(self._as_deletes(entries, manifests.EQUALITY_DELETES, ids)).commit(ref)

    def delete_vector(self, file_path: str, positions: Sequence[int], ref: str = "main") -> Table:
        """A deletion vector for one data file, in a Puffin file of its own."""
        b = puffin.Builder()
        blob = b.add(roaring.vector_blob(positions), "deletion-vector-v1", [2147483546], **{"referenced-data-file": file_path, "cardinality": str(len(set(positions)))})
        data, path = b.build(), f"{self.meta.location}/data/vector-{uuid.uuid4()}.puffin"
        files.write_bytes(self.spark, path, data)
        file = {
            "content": manifests.POSITION_DELETES, "file_path": path, "file_format": "PUFFIN", "partition": {}, "record_count": len(set(positions)),
            "file_size_in_bytes": len(data), "referenced_data_file": file_path, "content_offset": blob.offset, "content_size_in_bytes": blob.length,
        }
        return self.transaction().add([{"status": manifests.ADDED, "data_file": file}]).commit(ref)

    @staticmethod
    def _as_deletes(entries: list[dict], content: int, ids: list[int] | None = None) -> list[dict]:
        return [e | {"data_file": e["data_file"] | {"content": content, "equality_ids": ids, "partition": {}}} for e in entries]

    def transaction(self) -> Transaction:
        return Transaction(self)

    # ---- reading

    def plan(self, node=None, snapshot_id: int | None = None, ref: str | None = None, as_of_ms: int | None = None) -> DataFrame:
        return planning.plan_files(self.spark, self.meta, self.meta.snapshot(snapshot_id, ref, as_of_ms), node)

    def read(
        self,
        columns: Sequence[str] | None = None,
        filter_json: str = "",
        snapshot_id: int | None = None,
        ref: str | None = None,
        as_of_ms: int | None = None,
    ) -> DataFrame:
        """Live rows of a snapshot that pass the filter, with only the columns asked for.

        Files are pruned by partition and bounds first; the filter is pushed into the scan as well. Files without
        deletes are read apart from the others, so that their rows meet no join.
        """
        node = filters.from_json(filter_json)
        names = list(columns or [f["name"] for f in self.meta.schema_fields()])
        plan = self.plan(node, snapshot_id, ref, as_of_ms)
        tasks = planning.attached(plan).collect()
        if not tasks:
            return self.spark.createDataFrame([], self.schema).select(*names)
        clean = [t.file_path for t in tasks if not (t.vector or t.positional or t.equality)]
        dirty = [t for t in tasks if t.vector or t.positional or t.equality]
        parts = []
        for paths, todo in ((clean, []), ([t.file_path for t in dirty], dirty)):
            if paths:
                df = self._scan(paths)
                df = df.where(filters.compile_filter(df, node)) if node is not None else df
                parts.append((self._deleted(df, todo, plan) if todo else df).select(*names))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _scan(self, paths: list[str]) -> DataFrame:
        """Files by field id where they have ids, else by the name mapping or by name; absent columns take defaults."""
        mapping = self.meta.raw.get("properties", {}).get("schema.name-mapping.default")
        if mapping:
            return S.read_by_name_mapping(self.spark, self.schema, S.name_mapping(mapping), paths)
        return S.read_by_id(self.spark, self.schema, paths)

    def _deleted(self, df: DataFrame, tasks: list, plan: DataFrame) -> DataFrame:
        """Rows that the tasks' deletes leave. Joins know files and partitions by number: names would fill their memory."""
        numbers, parts = {planning.normal(p): str(i) for i, p in enumerate(sorted({t.file_path for t in tasks}))}, {}
        part = lambda text: None if text is None else parts.setdefault(text, str(len(parts)))
        df = df.select("*", F.col("_metadata.file_path").alias("_file_name"), F.col("_metadata.row_index").alias(deletes.POS))
        rows = [(planning.normal(t.file_path), numbers[planning.normal(t.file_path)], t.seq, part(t.partition)) for t in tasks]
        known = self.spark.createDataFrame(rows, f"p string, {deletes.FILE} string, {deletes.SEQ} long, {deletes.PART} string")
        df = df.join(F.broadcast(known), deletes.normal_path(F.col("_file_name")) == F.col("p")).drop("p", "_file_name")
        vectors = [(numbers[planning.normal(t.file_path)], t.vector.seq, roaring.read_vector_blob(files.read_range(self.spark, t.vector.path, t.vector.content_offset, t.vector.content_size)).tolist()) for t in tasks if t.vector]
        if vectors:
            df = deletes.deletion_vectors(df, self.spark.createDataFrame(vectors, "file_path string, seq long, positions array<long>"))
        pos = sorted({p for t in tasks for p in t.positional or []})
        info = {planning.normal(r.file_path): r for r in plan.where("content > 0").select("file_path", "seq", "partition", "unpartitioned").collect()} if pos or any(t.equality for t in tasks) else {}
        if pos:
            layers = self.spark.createDataFrame([(p, r.seq, part(r.partition)) for p, r in info.items()], "f string, seq long, partition string")
            raw = self.spark.read.schema("file_path string, pos long").parquet(*pos).select("*", deletes.normal_path(F.col("_metadata.file_path")).alias("f"))
            # positions of files that aren't read delete nothing
            named = self.spark.createDataFrame(list(numbers.items()), "p string, number string")
            raw = raw.join(F.broadcast(layers), "f").join(F.broadcast(named), deletes.normal_path(F.col("file_path")) == F.col("p"))
            df = deletes.positional(df, raw.select(F.col("number").alias("file_path"), "pos", "seq", "partition"))
        by_id = {f["id"]: f["name"] for f in self.meta.schema_fields()}
        sets: dict[tuple[str, ...], set[str]] = {}
        for t in tasks:
            for e in t.equality or []:
                sets.setdefault(tuple(by_id[i] for i in e.equality_ids), set()).add(e.d_file)
        frames = []
        for keys, paths in sets.items():
            layers = self.spark.createDataFrame([(p, r.seq, None if r.unpartitioned else part(r.partition)) for p, r in info.items()], "f string, seq long, partition string")
            wanted = T.StructType([self.schema[k] for k in keys])
            raw = S.read_by_id(self.spark, wanted, sorted(paths)).select("*", deletes.normal_path(F.col("_metadata.file_path")).alias("f"))
            frames.append((keys, raw.join(F.broadcast(layers), "f").drop("f")))
        return deletes.equality_sets(df, frames) if frames else df

    def metrics(self, plan: DataFrame) -> dict[str, int]:
        """Counts of a plan: files of each kind and deletes that delete nothing."""
        out = planning.summary(plan).first().asDict()
        out["dangling_positional"] = planning.dangling_positional(plan).count()
        out["dangling_vectors"] = planning.dangling_vectors(plan).count()
        return out


class Transaction:
    """Collects new files and commits them once, as one snapshot."""

    def __init__(self, table: Table):
        self.table, self.entries, self.done = table, [], False

    def add(self, entries: list[dict]) -> Transaction:
        self.entries += entries
        return self

    def commit(self, ref: str = "main") -> Table:
        if self.done:
            raise CommitError("the transaction is committed already")
        t, meta = self.table, TableMetadata.from_json(self.table.meta.to_json())
        raw, spark = meta.raw, t.spark
        seq, snapshot_id, now = raw["last-sequence-number"] + 1, uuid.uuid4().int >> 65, max(int(time.time() * 1000), raw["last-updated-ms"])
        parent = raw["refs"][ref]["snapshot-id"] if ref in raw.get("refs", {}) else raw.get("current-snapshot-id")
        rows = []
        if parent not in (None, -1):
            rows = manifests.read_list(files.read_bytes(spark, meta.snapshot(parent)["manifest-list"]))
        sources = {f["id"]: f["type"] for f in meta.schema_fields()}
        groups: dict[tuple[int, int | None], list[dict]] = {}
        for e in self.entries:
            groups.setdefault((int(e["data_file"]["content"] != manifests.DATA), e.get("spec_id")), []).append(e)
        for (content, own), mine in sorted(groups.items(), key=lambda g: (g[0][0], g[0][1] is not None, g[0][1] or 0)):
            # deletes that name no spec are unpartitioned
            spec = meta.spec() if not content else [] if own is None else next(s["fields"] for s in raw["partition-specs"] if s["spec-id"] == own)
            spec_id = raw["default-spec-id"] if own is None else own
            if content and own is None and meta.spec():
                spec_id = next((s["spec-id"] for s in raw["partition-specs"] if not s["fields"]), None)
                if spec_id is None:
                    spec_id = max(s["spec-id"] for s in raw["partition-specs"]) + 1
                    raw["partition-specs"].append({"spec-id": spec_id, "fields": []})
            partition = [(p["name"], p["field-id"], manifests.partition_type(p["transform"], sources[p["source-id"]])) for p in spec]
            data = manifests.write_manifest(({"status": e["status"], "data_file": e["data_file"], "snapshot_id": snapshot_id} for e in mine), partition, spec_id, content)
            path = f"{meta.location}/metadata/{uuid.uuid4()}-m{content}.avro"
            files.write_bytes(spark, path, data)
            rows.append(
                {
                    "manifest_path": path, "manifest_length": len(data), "partition_spec_id": spec_id, "content": content, "sequence_number": seq,
                    "min_sequence_number": seq, "added_snapshot_id": snapshot_id, "added_files_count": len(mine), "existing_files_count": 0,
                    "deleted_files_count": 0, "added_rows_count": sum(e["data_file"]["record_count"] for e in mine), "existing_rows_count": 0,
                    "deleted_rows_count": 0, "partitions": [_summary(k, [e["data_file"]["partition"].get(n) for e in mine]) for n, _, k in partition],
                }
            )
        listing = f"{meta.location}/metadata/snap-{snapshot_id}-{uuid.uuid4()}.avro"
        files.write_bytes(spark, listing, manifests.write_list(rows))
        added = [e["data_file"] for e in self.entries]
        summary = {
            "operation": "append" if all(f["content"] == 0 for f in added) else "overwrite",
            "added-data-files": str(sum(f["content"] == 0 for f in added)),
            "added-delete-files": str(sum(f["content"] != 0 for f in added)),
            "added-records": str(sum(f["record_count"] for f in added if f["content"] == 0)),
            "added-files-size": str(sum(f["file_size_in_bytes"] for f in added)),
        }
        snapshot = {"snapshot-id": snapshot_id, "sequence-number": seq, "timestamp-ms": now, "manifest-list": listing, "summary": summary, "schema-id": raw["current-schema-id"]}
        if parent not in (None, -1):
            snapshot["parent-snapshot-id"] = parent
        raw["snapshots"].append(snapshot)
        raw.setdefault("refs", {})[ref] = {"snapshot-id": snapshot_id, "type": "branch"}
        raw |= {"last-sequence-number": seq, "last-updated-ms": now}
        if ref == "main":
            raw["current-snapshot-id"] = snapshot_id
            raw.setdefault("snapshot-log", []).append({"snapshot-id": snapshot_id, "timestamp-ms": now})
        raw.setdefault("metadata-log", []).append({"metadata-file": t.metadata_location, "timestamp-ms": now})
        meta.check()
        number = int(re.match(r"v?(\d+)", t.metadata_location.rsplit("/", 1)[1])[1]) + 1
        # the version's name is fixed, so that of two writers only one can rename onto it
        path, draft = f"{meta.location}/metadata/{number:05d}-next.metadata.json", f"{meta.location}/metadata/.{uuid.uuid4()}.tmp"
        files.write_bytes(spark, draft, meta.to_json().encode())
        if not files.rename_new(spark, draft, path):
            raise CommitError(f"version {number} exists already")
        self.done = True
        return Table(spark, path, meta)


def _summary(kind: str, values: list) -> dict:
    known = [v for v in values if v is not None]
    low, high = (manifests.bound_bytes(kind, f(known)) if known else None for f in (min, max))
    return {"contains_null": len(known) < len(values), "contains_nan": None, "lower_bound": low, "upper_bound": high}
