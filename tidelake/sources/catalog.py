"""Catalogs that tell where a table's metadata is: Hive metastore, REST, Nessie, and plain folders."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidelake.sources import files
from tidelake.sources.table import Table


class CatalogError(LookupError):
    """A table the catalog doesn't know."""


def _fetch(url: str) -> dict:
    with urlopen(url, timeout=60) as r:  # noqa: S310
        return json.load(r)


class RestCatalog:
    def __init__(self, spark: SparkSession, url: str, warehouse: str, fetch: Callable[[str], dict] = _fetch):
        self.spark, self.url, self.warehouse, self.fetch = spark, url.rstrip("/"), warehouse, fetch

    def location(self, db: str, name: str) -> str:
        found = self.fetch(f"{self.url}/v1/{quote(self.warehouse)}/namespaces/{quote(db)}/tables/{quote(name)}")
        if "metadata-location" not in found:
            raise CatalogError(f"{db}.{name}")
        return found["metadata-location"]

    def load_table(self, db: str, name: str) -> Table:
        return Table.open(self.spark, self.location(db, name))


class NessieCatalog(RestCatalog):
    def __init__(self, spark: SparkSession, url: str, ref: str = "main", fetch: Callable[[str], dict] = _fetch):
        super().__init__(spark, url, "", fetch)
        self.ref = ref

    def location(self, db: str, name: str) -> str:
        found = self.fetch(f"{self.url}/api/v2/trees/{quote(self.ref)}/contents/{quote(f'{db}.{name}')}")
        where = found.get("content", found).get("metadataLocation")
        if not where:
            raise CatalogError(f"{db}.{name}")
        return where


class HiveCatalog:
    """Tables of the session's metastore whose property metadata_location names their metadata."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def location(self, db: str, name: str) -> str:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES `{db}`.`{name}`").collect()
        found = {r[0]: r[1] for r in rows}.get("metadata_location")
        if not found:
            raise CatalogError(f"{db}.{name}")
        return found

    def load_table(self, db: str, name: str) -> Table:
        return Table.open(self.spark, self.location(db, name))


class FolderCatalog:
    """Tables are folders below a root: db/name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create_table(self, db: str, name: str, schema: T.StructType, spec=()) -> Table:
        return Table.create(self.spark, f"{self.root}/{db}/{name}", schema, spec)

    def load_table(self, db: str, name: str) -> Table:
        return Table.open(self.spark, f"{self.root}/{db}/{name}")

    def tables(self) -> list[tuple[str, str]]:
        found = {tuple(p.split("/metadata/")[0].rsplit("/", 2)[1:]) for p, _ in files.listed(self.spark, self.root) if p.endswith(".metadata.json")}
        return sorted(found)
