"""Looking at, checking and moving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators import stats
from tidelake.sources import files, manifests, puffin
from tidelake.sources.metadata import POSTGRES, TableMetadata
from tidelake.sources.table import Table


def describe(table: Table, postgres: bool = False) -> list[tuple[str, str, bool]]:
    """(name, type, required) of each column, by the table's names for types or PostgreSQL's."""
    name = lambda t: POSTGRES.get(t, "numeric" + t[7:] if str(t).startswith("decimal") else str(t)) if postgres else str(t)
    return [(f["name"], name(f["type"]), f["required"]) for f in table.meta.schema_fields()]


def snapshots(table: Table) -> DataFrame:
    rows = [(s["snapshot-id"], s.get("parent-snapshot-id"), s["sequence-number"], s["timestamp-ms"], s["manifest-list"], s["summary"]) for s in table.meta.snapshots]
    return table.spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence_number long, timestamp_ms long, manifest_list string, summary map<string,string>")


def manifest_list(table: Table, snapshot_id: int | None = None) -> DataFrame:
    listed = manifests.read_list(files.read_bytes(table.spark, table.meta.snapshot(snapshot_id)["manifest-list"]))
    names = ["manifest_path", "content", "partition_spec_id", "sequence_number", "added_files_count", "added_rows_count"]
    return table.spark.createDataFrame([tuple(r[n] for n in names) for r in listed], "manifest_path string, content int, partition_spec_id int, sequence_number long, added_files_count int, added_rows_count long")


def puffin_blobs(table: Table, path: str) -> list[puffin.Blob]:
    return puffin.footer(files.read_bytes(table.spark, path))[0]


def validate_metadata(meta: TableMetadata, rules: dict) -> list[str]:
    """Broken rules: partitioned, sorted (bool), required_properties, forbidden_types, max_array_dims, tags (bool)."""
    out = []
    if "partitioned" in rules and bool(meta.spec()) != rules["partitioned"]:
        out.append("partitioned")
    orders = {o["order-id"]: o["fields"] for o in meta.raw.get("sort-orders", [])}
    if "sorted" in rules and bool(orders.get(meta.raw.get("default-sort-order-id", 0))) != rules["sorted"]:
        out.append("sorted")
    for k, v in rules.get("required_properties", {}).items():
        if meta.raw.get("properties", {}).get(k) != v:
            out.append(f"property {k}")

    def depth(t) -> int:
        return 1 + depth(t["element"]) if isinstance(t, dict) and t.get("type") == "list" else 0

    for f in meta.schema_fields():
        base = f["type"]
        while isinstance(base, dict) and base.get("type") == "list":
            base = base["element"]
        name = base if isinstance(base, str) else base.get("type")
        if name.split("(")[0].split("[")[0] in rules.get("forbidden_types", ()):
            out.append(f"type of {f['name']}")
        if depth(f["type"]) > rules.get("max_array_dims", 99):
            out.append(f"dimensions of {f['name']}")
    if rules.get("tags") is False and any(r["type"] == "tag" for r in meta.raw.get("refs", {}).values()):
        out.append("tags")
    return out


def validate_files(table: Table, rules: dict) -> list[str]:
    """Broken rules on files: max_data_files, max_delete_files, min_median_size."""
    plan = table.plan()
    c = plan.agg(F.count_if(F.col("content") == 0).alias("d"), F.count_if(F.col("content") > 0).alias("x")).first()
    out = [f"{n} data files" for n in [c.d] if n > rules.get("max_data_files", n)] + [f"{n} delete files" for n in [c.x] if n > rules.get("max_delete_files", n)]
    if "min_median_size" in rules and c.d:
        median = stats.size_percentiles(plan.where("content = 0"), "file_size", [50]).first().value
        if median < rules["min_median_size"]:
            out.append(f"median size {median}")
    return out


def store_statistics(table: Table, columns: list[str]) -> Table:
    """Theta sketches of columns in a Puffin file that the next metadata version names."""
    df, snapshot = table.read(columns), table.meta.snapshot()
    row = stats.theta_sketches(df, columns).first()
    estimates = {r.column: r.ndv for r in stats.ndv_theta(df, columns).collect()}
    b = puffin.Builder()
    for c in columns:
        b.add(_uncompressed(table, bytes(row[c])), "apache-datasketches-theta-v1", [table.meta.find_field(c)["id"]], snapshot["snapshot-id"], snapshot["sequence-number"], ndv=str(estimates[c]))
    data, path = b.build(), f"{table.meta.location}/metadata/{snapshot['snapshot-id']}.stats"
    files.write_bytes(table.spark, path, data, overwrite=True)
    blobs = [{"type": x.type, "snapshot-id": x.snapshot_id, "sequence-number": x.sequence_number, "fields": x.fields, "properties": x.properties} for x in b.blobs]
    return Table(table.spark, table.metadata_location, table.meta.with_statistics(snapshot["snapshot-id"], path, len(data), len(data) - b.blobs[-1].offset - b.blobs[-1].length, blobs))


def _uncompressed(table: Table, sketch: bytes) -> bytes:
    """Spark's sketches are compressed; other readers want the plain compact form."""
    jvm = table.spark._jvm
    memory = jvm.org.apache.datasketches.memory.Memory.wrap(sketch)
    return bytes(jvm.org.apache.datasketches.theta.Sketches.heapifySketch(memory).toByteArray())
