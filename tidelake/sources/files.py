"""Small metadata files through Hadoop's file systems (file, s3a, hdfs, ...), on the driver."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

#: Schemes that tables may live under.
SCHEMES = ("", "file", "s3", "s3a", "hdfs", "viewfs")


def split_url(url: str) -> tuple[str, str, str, dict[str, str]]:
    """(scheme, location, path, parameters)."""
    u = urlsplit(url)
    return u.scheme, u.netloc, u.path, dict(parse_qsl(u.query))


def _path(spark: SparkSession, path: str):
    if split_url(path)[0] not in SCHEMES:
        raise ValueError(f"scheme of {path!r} is not supported")
    p = spark._jvm.org.apache.hadoop.fs.Path(path.replace("s3://", "s3a://", 1))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    p, fs = _path(spark, path)
    with_stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream))
    finally:
        with_stream.close()


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Just a range of a file, for deletion vectors inside Puffin files."""
    p, fs = _path(spark, path)
    s = fs.open(p)
    try:
        s.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(s, length))
    finally:
        s.close()


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(data)
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename if the target isn't there yet: the step that makes a commit."""
    p, fs = _path(spark, source)
    return not exists(spark, target) and fs.rename(p, _path(spark, target)[0])


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder."""
    p, fs = _path(spark, folder)
    found, rows = fs.listFiles(p, True), []
    while found.hasNext():
        x = found.next()
        rows.append((x.getPath().toString(), x.getLen()))
    return sorted(rows)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or a folder, between file systems too."""
    (a, fa), (b, fb) = _path(spark, source), _path(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, spark._jsc.hadoopConfiguration())
