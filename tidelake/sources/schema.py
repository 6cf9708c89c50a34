"""Read schemas: columns matched by field id, missing ones filled with their initial defaults by the scan itself."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_ID, EXISTS_DEFAULT = "parquet.field.id", "EXISTS_DEFAULT"


def field(name: str, kind: T.DataType, field_id: int | None = None, required: bool = False, default_sql: str | None = None) -> T.StructField:
    """A field whose id and initial default (as SQL text) travel in its metadata."""
    metadata: dict[str, object] = {} if field_id is None else {FIELD_ID: field_id}
    if default_sql is not None:
        metadata |= {EXISTS_DEFAULT: default_sql, "CURRENT_DEFAULT": default_sql}
    return T.StructField(name, kind, not required, metadata)


def with_defaults(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """The frame with columns (type, default) that it lacks."""
    missing = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def name_mapping(text: str) -> dict[str, int]:
    """name -> field id of a name mapping (top level), for files that were written without field ids."""
    found: dict[str, int] = {}
    for entry in json.loads(text):
        for name in entry.get("names", []):
            if "field-id" in entry:
                if name in found:
                    raise ValueError(f"name {name!r} is mapped twice")
                found[name] = entry["field-id"]
    return found


def read_by_id(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """Parquet files read with columns matched by field id; absent ids take their default or null."""
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    return spark.read.schema(schema).parquet(*paths)


def read_by_name_mapping(spark: SparkSession, schema: T.StructType, mapping: dict[str, int], paths: list[str]) -> DataFrame:
    """Files without ids: each column of the schema is looked up under the names that map to its id."""
    by_id = {v: k for k, v in mapping.items()}
    raw = spark.read.parquet(*paths)
    out = []
    for fd in schema.fields:
        name = by_id.get(fd.metadata.get(FIELD_ID), fd.name)
        if name in raw.columns:
            out.append(F.col(f"`{name}`").cast(fd.dataType).alias(fd.name))
        else:
            out.append(F.expr(fd.metadata.get(EXISTS_DEFAULT, "NULL")).cast(fd.dataType).alias(fd.name))
    return raw.select(*out)
