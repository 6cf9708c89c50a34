"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Also turns every byte that is not part of a [0-9a-z] or non-ASCII word into a space.
WORDS_ONLY = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo the divisor (null ids give null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else one in its warehouse."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/staged").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Set while a table is staged. Spark removes a command's shuffle files when the command is done. Arrow batches are small, as
#: every task holds one in the JVM and one in Python: texts of some KB make tens of MB in batches of the usual size.
WHILE_STAGED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. The session's settings are put back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = {key: spark.conf.get(key, None) for key in WHILE_STAGED}
    for key, value in WHILE_STAGED.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, rows: Callable[[], Callable[[list, list[bytes]], dict]], schema: str
) -> DataFrame:
    """Apply a function of (ids, texts as UTF-8 bytes) to every batch of documents; null texts come as b"".

    ``rows()`` is called once in every task and returns the function, which maps a batch to columns named as in schema.
    """
    pairs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = to_arrow_schema(StructType.fromDDL(schema))
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if part.num_rows:
                    out = of(part.column(0).to_pylist(), part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], type=kind.field(n).type) for n in names], schema=kind
                    )

    return pairs.mapInArrow(run, schema)
