"""Table metadata: JSON in and out, types, checks, snapshot selection."""

from __future__ import annotations

import copy
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidelake.sources import schema as S

#: Names of primitive types and the Spark types that hold them.
PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp_ns": T.LongType(), "timestamptz_ns": T.LongType(),
    "string": T.StringType(), "uuid": T.BinaryType(), "binary": T.BinaryType(),
}
#: The same types as PostgreSQL names them.
POSTGRES = {
    "boolean": "bool", "int": "int4", "long": "int8", "float": "float4", "double": "float8", "date": "date",
    "time": "time", "timestamp": "timestamp", "timestamptz": "timestamptz", "string": "text", "uuid": "uuid",
    "binary": "bytea",
}


class MetadataError(ValueError):
    """Metadata that can't be read or breaks a rule."""


def spark_type(kind: object) -> T.DataType:
    """The Spark type of a type in metadata JSON; lists nest, maps and structs are read too."""
    if isinstance(kind, dict):
        if kind.get("type") == "list":
            return T.ArrayType(spark_type(kind["element"]), not kind.get("element-required", False))
        if kind.get("type") == "map":
            return T.MapType(spark_type(kind["key"]), spark_type(kind["value"]), not kind.get("value-required", False))
        if kind.get("type") == "struct":
            return spark_schema(kind["fields"])
        raise MetadataError(f"unknown type {kind!r}")
    if kind in PRIMITIVES:
        return PRIMITIVES[kind]
    if m := re.fullmatch(r"decimal\((\d+),\s*(-?\d+)\)", kind):
        p, s = int(m[1]), int(m[2])
        if not 0 < p <= 38:
            raise MetadataError(f"precision of {kind}")
        return T.DecimalType(min(38, p - s), 0) if s < 0 else T.DecimalType(p, s)
    if m := re.fullmatch(r"fixed\[(\d+)\]", kind):
        if not int(m[1]):
            raise MetadataError("fixed needs a length")
        return T.BinaryType()
    raise MetadataError(f"unknown type {kind!r}")


def type_name(kind: T.DataType) -> object:
    """The metadata name of a Spark type."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision}, {kind.scale})"
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "int"
    for name, known in PRIMITIVES.items():
        if known == kind:
            return name
    raise MetadataError(f"no type for {kind.simpleString()}")


def default_sql(kind: object, value: object) -> str | None:
    """An initial default as SQL text for the scan."""
    if value is None:
        return None
    if kind in ("boolean", "int", "long", "float", "double"):
        return f"CAST({json.dumps(value) if isinstance(value, bool) else value!r} AS {spark_type(kind).simpleString()})".replace("'", "")
    if kind in ("date", "timestamp", "timestamptz"):
        return f"CAST('{value}' AS {spark_type(kind).simpleString()})"
    if kind == "time":
        h, m, s = value.split(":")
        return f"CAST({(int(h) * 60 + int(m)) * 60_000_000 + round(float(s) * 1e6)} AS BIGINT)"
    if kind == "uuid":
        return f"X'{uuid.UUID(value).hex}'"
    if kind == "binary" or isinstance(kind, str) and kind.startswith("fixed"):
        return f"X'{value}'"
    if kind == "string":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(kind, str) and kind.startswith("decimal"):
        return f"CAST('{value}' AS {spark_type(kind).simpleString()})"
    raise MetadataError(f"a default of type {kind!r} is not supported")


def spark_schema(fields: list[dict]) -> T.StructType:
    """Fields as a Spark schema that carries ids and defaults, for reading by id."""
    out, seen = [], set()
    for f in fields:
        if f["id"] in seen:
            raise MetadataError(f"field id {f['id']} is used twice")
        seen.add(f["id"])
        out.append(S.field(f["name"], spark_type(f["type"]), f["id"], False, default_sql(f["type"], f.get("initial-default"))))
    return T.StructType(out)


_REQUIRED = ("format-version", "table-uuid", "location", "last-column-id", "schemas", "current-schema-id", "partition-specs")


@dataclass
class TableMetadata:
    """Metadata as parsed; ``raw`` keeps every member so that writing gives back what was read."""

    raw: dict = field(default_factory=dict)

    @staticmethod
    def from_json(text: str | bytes) -> TableMetadata:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise MetadataError(str(e)) from e
        if not isinstance(raw, dict) or (missing := [k for k in _REQUIRED if k not in raw]):
            raise MetadataError("not table metadata" if not isinstance(raw, dict) else f"missing {missing}")
        m = TableMetadata(raw)
        m.check()
        return m

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(self.raw, indent=2 if pretty else None, separators=None if pretty else (",", ":"))

    def check(self) -> None:
        """Rules that hold for every table; those of ``check_order`` are a writer's choice."""
        ids = [s["schema-id"] for s in self.raw["schemas"]]
        if self.raw["current-schema-id"] not in ids or len(set(ids)) != len(ids):
            raise MetadataError("the current schema is not among the schemas")
        for s in self.raw["schemas"]:
            spark_schema(s["fields"])
        if self.raw.get("default-spec-id", 0) not in [s["spec-id"] for s in self.raw["partition-specs"]]:
            raise MetadataError("the default partition spec is missing")
        known = {s["snapshot-id"] for s in self.snapshots}
        current = self.raw.get("current-snapshot-id")
        if current not in (None, -1) and current not in known:
            raise MetadataError("the current snapshot is missing")
        for name, ref in self.raw.get("refs", {}).items():
            if ref["snapshot-id"] not in known:
                raise MetadataError(f"ref {name!r} points nowhere")
        if any(s.get("sequence-number", 0) > self.raw.get("last-sequence-number", 0) for s in self.snapshots):
            raise MetadataError("a snapshot is newer than the last sequence number")

    def check_order(self, slack_ms: int = 60_000) -> None:
        """Logs must be ordered by time, up to a minute, as other writers require."""
        for log in ("snapshot-log", "metadata-log"):
            times = [e["timestamp-ms"] for e in self.raw.get(log, [])]
            if any(b < a - slack_ms for a, b in zip(times, times[1:], strict=False)):
                raise MetadataError(f"{log} is not ordered by time")

    @property
    def location(self) -> str:
        return self.raw["location"]

    @property
    def snapshots(self) -> list[dict]:
        return self.raw.get("snapshots", [])

    def schema_fields(self, schema_id: int | None = None) -> list[dict]:
        wanted = self.raw["current-schema-id"] if schema_id is None else schema_id
        return next(s["fields"] for s in self.raw["schemas"] if s["schema-id"] == wanted)

    def find_field(self, name: str, ignore_case: bool = False) -> dict | None:
        same = (lambda x: x.lower() == name.lower()) if ignore_case else (lambda x: x == name)
        return next((f for f in self.schema_fields() if same(f["name"])), None)

    def spec(self, spec_id: int | None = None) -> list[dict]:
        wanted = self.raw.get("default-spec-id", 0) if spec_id is None else spec_id
        return next(s["fields"] for s in self.raw["partition-specs"] if s["spec-id"] == wanted)

    def snapshot(self, snapshot_id: int | None = None, ref: str | None = None, as_of_ms: int | None = None) -> dict | None:
        """The current snapshot, one by id, by branch or tag, or the newest not after a time."""
        if ref is not None:
            if ref not in self.raw.get("refs", {}):
                raise MetadataError(f"no ref {ref!r}")
            snapshot_id = self.raw["refs"][ref]["snapshot-id"]
        elif as_of_ms is not None:
            old = [s for s in self.snapshots if s["timestamp-ms"] <= as_of_ms]
            return max(old, key=lambda s: s["timestamp-ms"]) if old else None
        elif snapshot_id is None:
            snapshot_id = self.raw.get("current-snapshot-id")
            if snapshot_id in (None, -1):
                return None
        found = next((s for s in self.snapshots if s["snapshot-id"] == snapshot_id), None)
        if found is None:
            raise MetadataError(f"no snapshot {snapshot_id}")
        return found

    def without_columns(self, names: set[str]) -> TableMetadata:
        raw = copy.deepcopy(self.raw)
        for s in raw["schemas"]:
            s["fields"] = [f for f in s["fields"] if f["name"] not in names]
        return TableMetadata(raw)

    def relocated(self, old: str, new: str) -> TableMetadata:
        """The metadata with every path below ``old`` moved to ``new``."""
        move = lambda x: (
            new + x[len(old) :] if isinstance(x, str) and (x == old or x.startswith(old.rstrip("/") + "/"))
            else {k: move(v) for k, v in x.items()} if isinstance(x, dict)
            else [move(v) for v in x] if isinstance(x, list) else x
        )
        return TableMetadata(move(self.raw))

    def with_sort_order(self, fields: list[dict]) -> TableMetadata:
        """The default sort order set to these fields; an order that is known already keeps its id."""
        raw = copy.deepcopy(self.raw)
        orders = raw.setdefault("sort-orders", [])
        known = next((o for o in orders if o["fields"] == fields), None)
        if known is None:
            known = {"order-id": max([0, *(o["order-id"] for o in orders)]) + 1 if fields else 0, "fields": fields}
            orders.append(known)
        raw["default-sort-order-id"] = known["order-id"]
        return TableMetadata(raw)

    def with_statistics(self, snapshot_id: int, path: str, size: int, footer_size: int, blobs: list[dict]) -> TableMetadata:
        raw = copy.deepcopy(self.raw)
        kept = [s for s in raw.get("statistics", []) if s["snapshot-id"] != snapshot_id]
        entry = {"snapshot-id": snapshot_id, "statistics-path": path, "file-size-in-bytes": size, "file-footer-size-in-bytes": footer_size, "blob-metadata": blobs}
        raw["statistics"] = [*kept, entry]
        return TableMetadata(raw)


def new_metadata(location: str, schema: T.StructType, spec: list[tuple[str, str]] = (), properties: dict | None = None) -> TableMetadata:
    """Metadata of an empty table; spec: (column, transform) pairs."""
    fields = [{"id": i, "name": f.name, "required": not f.nullable, "type": type_name(f.dataType)} for i, f in enumerate(schema.fields, 1)]
    ids = {f["name"]: f["id"] for f in fields}
    parts = [
        {"source-id": ids[c], "field-id": 1000 + i, "name": c if t == "identity" else f"{c}_{t.split('[')[0]}", "transform": t}
        for i, (c, t) in enumerate(spec)
    ]
    return TableMetadata.from_json(
        json.dumps(
            {
                "format-version": 2, "table-uuid": str(uuid.uuid4()), "location": location, "last-sequence-number": 0,
                "last-updated-ms": int(time.time() * 1000), "last-column-id": len(fields), "current-schema-id": 0,
                "schemas": [{"type": "struct", "schema-id": 0, "fields": fields}], "default-spec-id": 0,
                "partition-specs": [{"spec-id": 0, "fields": parts}], "last-partition-id": 999 + len(parts),
                "default-sort-order-id": 0, "sort-orders": [{"order-id": 0, "fields": []}],
                "properties": properties or {}, "current-snapshot-id": -1, "refs": {}, "snapshots": [],
                "snapshot-log": [], "metadata-log": [], "statistics": [],
            }
        )
    )
