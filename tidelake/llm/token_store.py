"""Token ids in a content-addressed store.

A document's ids are cut into chunks where a rolling hash of the last ids matches, so equal passages give equal
chunks wherever they stand. A chunk is named by the SHA-256 of its ids and stored once. A document is a recipe: the
names of its chunks in order. The store is a folder of Parquet tables:

    chunks/    digest binary, n_ids int, payload binary (zstd of little-endian ids, 16 bits wide where all fit)
    recipes/   doc_id, start (ids of all documents before it), n_tokens, chunks array<binary>, root string;
               files hold ascending ranges of doc_id and are sorted by it
    manifest/  kind, part, n_rows, n_ids, root string: a Merkle tree of three levels above the chunks; a recipe's root is
               the SHA-256 of its chunks' names; a part's is that of its rows' in order, where a recipe's row is its id,
               start, length and root, and a chunk's its name; the top's (part -1) is that of its parts' roots

Reading checks every payload against its name, every recipe against its root, and the manifest, made again from the
recipes and chunks that are there, against the stored one; what is missing or differs raises. The checksum of a
document is put together from its chunks' checksums (crc32 of a joined string follows from the parts' and their
lengths), so verifying moves no payloads; ``read_ids`` brings the ids themselves back.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm.common import dropped, map_texts, staged
from tidelake.llm.tokenizers_io import encoder

WINDOW, MASK, LONGEST = 16, 1023, 8192
#: At most this many chunks that other tasks hold too are looked up from every task; above, the tables are joined.
SENT_CHUNKS = 200_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def _hashed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
    x ^= x >> np.uint64(29)
    return x


#: Hashes of the ids that fit into 16 bits.
_SMALL = _hashed(np.arange(1 << 16))


def _hashes(ids: np.ndarray) -> np.ndarray:
    return _SMALL[ids] if int(ids.max()) < len(_SMALL) else _hashed(ids)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last WINDOW ids has its low bits clear, at the latest after LONGEST."""
    n = len(ids)
    if n <= WINDOW:
        return [n] if n else []
    # sums of WINDOW ids' hashes; unsigned, so that they wrap around
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_hashes(ids), out=total[1:])
    rolled = total[WINDOW:] - total[:-WINDOW]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled &= np.uint64(MASK << 40)
    found = np.flatnonzero(rolled == 0) + WINDOW
    ends, at = [], 0
    for end in [*found.tolist(), n]:
        while end - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if end > at and (end - at >= WINDOW or end == n):
            ends.append(end)
            at = end
    return ends


def packed(ids: np.ndarray, compress: Callable[[bytes], bytes]) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"4" if wide else b"2") + compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(payload: bytes, decompress: Callable[[bytes], bytes]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    data = decompress(payload[1:])
    return data if payload[:1] == b"4" else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def recipe_root(names: list[bytes]) -> str:
    return hashlib.sha256("".join(x.hex().upper() for x in names).encode()).hexdigest()


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


class CrcJoin:
    """crc32 of a joined string from the crc32 of its parts: shifts by zero bytes are linear maps over GF(2)."""

    def __init__(self):
        one = [0xEDB88320, *(1 << k for k in range(31))]  # by one zero bit; the reversed CRC-32 polynomial
        self.powers = [one]
        for _ in range(40):
            m = self.powers[-1]
            self.powers.append([_times(m, row) for row in m])
        self.shifts: dict[int, list[int]] = {}

    def shift(self, n: int) -> list[int]:
        """The map by n zero bytes."""
        if n not in self.shifts:
            if len(self.shifts) > 20_000:
                self.shifts.clear()
            out, bits, k = [1 << i for i in range(32)], n * 8, 0
            while bits:
                if bits & 1:
                    out = [_times(self.powers[k], row) for row in out]
                bits >>= 1
                k += 1
            self.shifts[n] = out
        return self.shifts[n]

    def joined(self, parts: list[tuple[int, int]]) -> int:
        """parts: crc32 and length in bytes of each."""
        crc = 0
        for c, n in parts:
            # in two steps, so that there are few maps for lengths of some KB; a crc of 0 stays as it is
            for step in (n & ~511, n & 511):
                if crc and step:
                    crc = _times(self.shift(step), crc)
            crc ^= c
        return crc


#: One for each worker process; its maps are the same for all.
_CRC: list[CrcJoin] = []


def crc_join() -> CrcJoin:
    if not _CRC:
        _CRC.append(CrcJoin())
    return _CRC[0]


def _chunked(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_tokens, digests, sizes, payloads): row is unique; a payload is null where its task gave it before."""

    def rows():
        import zstandard
        from pyspark import TaskContext

        encode, compress = encoder(path).all_ids, zstandard.ZstdCompressor(level=1).compress
        last, seen = np.array([end_id], "<u4").tobytes(), set()
        row = count(TaskContext.get().partitionId() << 33)

        def of(ids, texts):
            out = {"id": ids, "row": [next(row) for _ in ids], "n_tokens": [], "digests": [], "sizes": [], "payloads": []}
            for data in encode(texts):
                data += last
                array = np.frombuffer(data, "<u4")
                at, digests, sizes, payloads = 0, [], [], []
                for end in cuts(array):
                    digest = hashlib.sha256(data[4 * at : 4 * end]).digest()
                    new = digest not in seen
                    if new:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(digest)
                    digests.append(digest)
                    sizes.append(end - at)
                    payloads.append(packed(array[at:end], compress) if new else None)
                    at = end
                out["n_tokens"].append(len(array))
                out["digests"].append(digests)
                out["sizes"].append(sizes)
                out["payloads"].append(payloads)
            return out

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, n_tokens long, digests array<binary>, sizes array<int>, payloads array<binary>"
    return map_texts(docs, id_col, text_col, rows, schema)


def write_store(
    docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, append end_id, and write the store to a new folder in ascending id order.

    Null and empty texts are documents of just the end id. Repeated ids are documents of their own, next to each other.
    An empty table gives an empty store.
    """
    spark = docs.sparkSession
    encoded = staged(_chunked(docs, path, end_id, id_col, text_col), "encoded")
    given = encoded.select("row", F.posexplode(F.transform("payloads", lambda p: p.isNotNull())).alias("at", "new"), "digests")
    given = given.where("new").select("row", "at", F.get("digests", F.col("at")).alias("digest"))
    # a chunk that several tasks gave is stored from the first; only the others' places are moved, no payloads
    owners = given.groupBy("digest").agg(F.min(F.struct("row", "at")).alias("own"), F.count("*").alias("n")).where("n > 1")
    again = staged(given.join(owners, "digest").where("row <> own.row OR at <> own.at").select("row", "at"), "again")
    few = again.count() <= SENT_CHUNKS
    (
        encoded.select("row", F.posexplode(F.arrays_zip("digests", "sizes", "payloads")).alias("at", "c"))
        .where("c.payloads IS NOT NULL")
        .join(F.broadcast(again) if few else again, ["row", "at"], "left_anti")
        .select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n_ids"), F.col("c.payloads").alias("payload"))
        .write.option("compression", "none")
        .parquet(f"{folder}/chunks")
    )
    ranged = encoded.select(F.col("id").alias("doc_id"), "row", "n_tokens", F.col("digests").alias("chunks"))
    ordered = staged(
        ranged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "row").select("*", F.spark_partition_id().alias("part")),
        "ordered",
    )
    dropped(encoded, again)
    # a row for each part of the range partitioning, not for each document, decides where the parts start
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base")
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    (
        ordered.join(offsets, "part")
        .withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .withColumn("root", F.sha2(F.array_join(F.transform("chunks", F.hex), ""), 256))
        .select("doc_id", "start", "n_tokens", "chunks", "root", "part")
        .sortWithinPartitions("part", "start")
        .write.parquet(f"{folder}/recipes")
    )
    dropped(ordered)
    _manifest(spark, folder).write.parquet(f"{folder}/manifest")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each part of the recipes and of the chunks, and one for the top of either."""
    # names meet in parts of a few thousand rows whatever the store's size, then the parts' roots in the top
    stored = spark.read.parquet(f"{folder}/chunks").select("digest", "n_ids")
    digits = max(1, math.ceil(math.log(max(1, stored.count()) / 4096, 16)))
    recipes = spark.read.parquet(f"{folder}/recipes").select(
        F.lit("recipes").alias("kind"),
        F.floor(F.col("start") / 4_000_000).alias("part"),
        F.col("start").alias("at"),
        F.sha2(F.concat(F.to_json(F.struct("doc_id", "start", "n_tokens")), "root"), 256).alias("name"),
        F.col("n_tokens").alias("n"),
    )
    name = F.hex("digest")
    chunks = stored.select(
        F.lit("chunks").alias("kind"),
        F.conv(F.substring(name, 1, digits), 16, 10).cast("long").alias("part"),
        F.lit(0).cast("long").alias("at"),
        name.alias("name"),
        F.col("n_ids").cast("long").alias("n"),
    )

    def rooted(rows: DataFrame, n_rows: Column) -> DataFrame:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
        return rows.groupBy("kind", "part").agg(
            n_rows.alias("n_rows"), F.sum("n").alias("n_ids"), F.sha2(F.array_join(in_order, ""), 256).alias("root")
        )

    parts = staged(rooted(recipes.unionByName(chunks), F.count("*")), "roots")
    tops = parts.select("kind", F.lit(-1).cast("long").alias("part"), F.col("part").alias("at"), F.col("root").alias("name"), F.col("n_ids").alias("n"), "n_rows")
    return parts.unionByName(rooted(tops, F.sum("n_rows")))


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Raise where the stored manifest isn't that of the recipes and chunks that are there."""
    names = ["kind", "part", "n_rows", "n_ids", "root"]
    there, stored = (x.select(F.struct(*names).alias("row"), "kind", "part") for x in (_manifest(spark, folder), spark.read.parquet(f"{folder}/manifest")))
    both = there.withColumnRenamed("row", "made").join(stored.withColumnRenamed("row", "stored"), ["kind", "part"], "full")
    wrong = both.where("NOT made <=> stored").select("kind", "part").first()
    if wrong:
        raise ValueError(f"the manifest doesn't match the {wrong.kind} of part {wrong.part}")


def chunk_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_ids, crc): every stored chunk, read and verified against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            crcs = []
            for digest, n, payload in zip(*(batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(3)), strict=True):
                data = unpacked(payload, decompress)
                if hashlib.sha256(data).digest() != digest or len(data) != 4 * n:
                    raise ValueError(f"a stored chunk differs from its name {digest.hex()}")
                crcs.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"]
            )

    stored = spark.read.parquet(f"{folder}/chunks").select("digest", "n_ids", "payload")
    return stored.mapInArrow(run, "digest binary, n_ids int, crc long")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; fails where a file isn't what it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = crc_join()
        for batch in batches:
            sums = []
            for n, names, root, parts in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if parts is None or any(p["crc"] is None for p in parts):
                    raise ValueError("a recipe's chunk is missing")
                parts = sorted((p["at"], p["crc"], p["n_ids"]) for p in parts)
                if len(parts) != len(names) or sum(p[2] for p in parts) != n or recipe_root(names) != root:
                    raise ValueError("a recipe doesn't match the store")
                sums.append(crc.joined([(c, 4 * k) for _, c, k in parts]))
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    check_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", "chunks", "root")
    parts = (
        recipes.select("start", F.posexplode("chunks").alias("at", "digest"))
        .join(chunk_sums(spark, folder), "digest", "left")
        .groupBy("start")
        .agg(F.collect_list(F.struct("at", "n_ids", "crc")).alias("parts"))
    )
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return recipes.join(parts, "start", "left").select("doc_id", "start", "n_tokens", "chunks", "root", "parts").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<long>): the ids themselves, put together from the chunks and checked as ``verified`` does."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<long>")
    def joined(parts, chunks, n_tokens, root):
        import pandas as pd
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        rows = []
        for x, names, n, r in zip(parts, chunks, n_tokens, root, strict=True):
            if x is None or any(p["payload"] is None for p in x):
                raise ValueError("a recipe's chunk is missing")
            data = [unpacked(bytes(p["payload"]), decompress) for p in sorted(x, key=lambda p: p["at"])]
            names = [bytes(name) for name in names]
            if [hashlib.sha256(d).digest() for d in data] != names or sum(map(len, data)) != 4 * n or recipe_root(names) != r:
                raise ValueError("a recipe doesn't match the store")
            rows.append(np.frombuffer(b"".join(data), "<u4").astype(np.int64))
        return pd.Series(rows)

    check_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    parts = (
        recipes.select("start", F.posexplode("chunks").alias("at", "digest"))
        .join(spark.read.parquet(f"{folder}/chunks"), "digest", "left")
        .groupBy("start")
        .agg(F.collect_list(F.struct("at", "payload")).alias("parts"))
    )
    return recipes.join(parts, "start", "left").select("doc_id", "start", joined("parts", "chunks", "n_tokens", "root").alias("ids"))
