"""MinHash near-dedup with odd sketches.

A document's 5-word shingle set gives SAMPLES MinHash samples. The first ``BANDS * ROWS`` of them make bands, the buckets
in which documents meet. All samples together are folded into an odd sketch: each sample toggles one bit of a bitmap, so equal
samples of two documents cancel in the XOR of their sketches, and its population count estimates a high similarity
precisely. Pairs whose estimate lies far below the threshold go; the others are confirmed on their full shingle sets.
Where a bucket's documents are many and not one group, those that also share one of their rarest shingles are left: as
many are taken of each set as no link can do without. These carry an odd sketch of the set itself, whose XOR has no more
bits than the sets have shingles apart; in sets of some 1,800 shingles and fewer it tells links almost exactly and misses none.

At the threshold of 0.85 a pair shares no band with a chance of (1 - 0.85^4)^32 < 1e-10. The estimate is cut at 5.5
of its standard deviations (about 0.79). Documents with equal sets are one class before all
that, named by a number made from the set's digest, so ids may repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import dropped, map_texts, staged
from tidelake.llm.links import Finer, linked, looked_up
from tidelake.llm.shingles import mixed, shingle_sets

BANDS, ROWS = 32, 4
SAMPLES, SKETCH_BITS = 1024, 4096
#: Bits of the odd sketch of a set itself.
SET_BITS = 2048
#: Counters from which the order of shingles by frequency is taken.
COUNTERS = 1 << 20
#: Members that meet one copy of a hub's text.
PER_HUB = 64


def _random(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32))


_FLIPS, _FACTORS = _random(SAMPLES, 1), _random(SAMPLES, 2) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, SAMPLES) MinHash samples of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((flat ^ _FLIPS[k]) * _FACTORS[k], starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(n, SKETCH_BITS / 8) bytes: bit parity of the samples that fall on each bit."""
    bits = (mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.intp)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    rows = np.arange(len(samples))
    for k in range(SAMPLES):
        parity[rows, bits[:, k]] ^= 1
    return np.packbits(parity, axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; a key holds its band's number."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + samples[:, r : BANDS * ROWS : ROWS])
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def set_sketch(own: np.ndarray) -> np.ndarray:
    """SET_BITS / 64 numbers: the parity of a set's shingles on each bit."""
    counts = np.bincount((mixed(own) % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def most_set_bits(x_size: Column, y_size: Column, percent: int) -> Column:
    """The population count that the XOR of two links' set sketches doesn't exceed.

    Sets that link are at most ``apart`` shingles apart, each of which toggles one bit, so there are no more odd bits than
    that. In large sets bits meet, and the count stays below 5.5 standard deviations above its mean (chance below 1e-7).
    """
    apart = F.floor((x_size + y_size) * (100 - percent) / (100 + percent))
    once = F.exp(apart * (-2 / SET_BITS))
    mean = (1 - once) * (SET_BITS / 2)
    variance = (1 - once * once) * (SET_BITS / 4) - apart * once * once
    return F.least(apart, F.ceil(mean + 5.5 * F.sqrt(F.greatest(variance, F.lit(0.0)))))


def most_odd_bits(percent: int) -> int:
    """The population count of the XOR that a pair at the threshold exceeds with a chance below 1e-7.

    Of SAMPLES samples a binomial number differs, each difference toggles two bits, and bits that meet cancel.
    """
    j = percent / 100
    toggled = 2 * SAMPLES * (1 - j)
    mean = SKETCH_BITS / 2 * (1 - math.exp(-2 * toggled / SKETCH_BITS))
    from_samples = 2 * math.sqrt(SAMPLES * j * (1 - j)) * math.exp(-2 * toggled / SKETCH_BITS)
    from_bits = math.sqrt(max(0.0, SKETCH_BITS / 4 * (1 - math.exp(-4 * toggled / SKETCH_BITS)) - toggled * math.exp(-4 * toggled / SKETCH_BITS)))
    return math.ceil(mean + 5.5 * math.hypot(from_samples, from_bits))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest of the set, bands, sketch); nulls in the last three for documents without words."""

    def rows():
        def of(ids, texts):
            out = {"id": ids, "n_shingles": [], "digest": [], "bands": [], "sketch": []}
            for at in range(0, len(texts), 100):
                sets = shingle_sets(texts[at : at + 100])
                full = [s for s in sets if len(s)]
                samples = signatures(full) if full else np.zeros((0, SAMPLES), np.uint64)
                found = iter(zip(band_keys(samples).tolist(), odd_sketches(samples).view("<i8").tolist(), strict=True))
                for s in sets:
                    out["n_shingles"].append(len(s))
                    b, w = next(found) if len(s) else (None, None)
                    out["digest"].append(_digest(s) if len(s) else None)
                    out["bands"].append(b)
                    out["sketch"].append(w)
            return out

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    return map_texts(docs, id_col, text_col, rows, schema)


def _odd_bits(a: str, b: str, bits: int = SKETCH_BITS):
    """Population count of the XOR of two sketches, in generated code."""
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(bits // 64))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: (id, set as binary), one row for each id in pairs.

    A hub that occurs in many pairs is copied once for every PER_HUB of them, so no task gathers its whole group.
    """
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PER_HUB)).alias("salt")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(counts, "a").select("a", "b", salt)
    hubs = salted.select("a", "salt").distinct()
    left = hubs.join(sets, hubs.a == sets.id).select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
    right = salted.join(sets, salted.b == sets.id).select("a", "salt", "b", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in batches:
            found_a, found_b = [], []
            for x, z, y, own in zip(*(batch.column(k) for k in range(4)), strict=True):
                x, z, y, own = x.as_py(), z.as_py(), y.as_py(), np.frombuffer(own.as_buffer(), np.uint64)
                if y is None:
                    now, hub = (x, z), own.copy()
                elif (x, z) == now:
                    both = len(hub) + len(own)
                    common = both - len(np.union1d(hub, own))
                    if 100 * common >= percent * (both - common):
                        found_a.append(x)
                        found_b.append(y)
                else:
                    raise ValueError("a member without its hub")
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return (
        left.union(right)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(run, "a long, b long")
    )


def counted(sets: DataFrame) -> np.ndarray:
    """How often shingles of the sets (id, set) fall on each of COUNTERS counters, at most 65,535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            own = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(0)]
            if own:
                counts += np.bincount((np.concatenate(own) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 10_000):
            part = at[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["at", "n"])

    found = sets.select("set").mapInArrow(run, "at long, n long").groupBy("at").agg(F.least(F.sum("n"), F.lit(65535)).alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.uint16)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, key, at, size, bits): the rarest shingles of each set, their places in its order, its size and its sketch.

    All sets are put in one order, by the counters and then by the shingles themselves. Sets that link have at least
    ceil(percent * (size + other size) / (100 + percent)) shingles in common; the first of these stands on both sides
    before so many places from the end. So any total order is right, and counters that several shingles share cost time only.
    A shingle whose counter is 1 is in no other set.
    """

    width = SET_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at, size, bits = [], [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                n = counts[(own % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.argsort(n, kind="stable")[: len(own) - -(-percent * len(own) // 100) + 1]  # sets are sorted
                places = np.flatnonzero(n[first] > 1)
                ids.append(np.full(len(places), i, np.int64))
                size.append(np.full(len(places), len(own), np.int64))
                keys.append(own[first[places]].view(np.int64))
                at.append(places)
                bits.append(np.tile(set_sketch(own), len(places)))
            # few rows at a time, as each holds a sketch
            columns = [np.concatenate(x) for x in (ids, keys, at, size, bits)] if ids else [()]
            for k in range(0, len(columns[0]), 5_000):
                rows = [pa.array(x[k : k + 5_000]) for x in columns[:4]]
                own = columns[4][k * width : (k + 5_000) * width]
                starts = np.arange(0, len(own) + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(starts, own)], names=["id", "key", "at", "size", "bits"])

    return sets.select("id", "set").mapInArrow(run, "id long, key long, at long, size long, bits array<long>")


def _digest(own: np.ndarray) -> bytes:
    return hashlib.sha256(own.tobytes()).digest()[:20]


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, set as binary) of documents with words."""

    def rows():
        def of(ids, texts):
            sets = shingle_sets(texts)
            return {"id": ids, "digest": [_digest(s) for s in sets], "set": [s.tobytes() for s in sets]}

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, rows, f"id {kind}, digest binary, set binary")


def _numbered(classes: DataFrame) -> DataFrame:
    """(digest, rep, node): a number for each class. Digests whose numbers meet are dealt out again."""
    first = classes.withColumn("node", F.xxhash64("digest"))
    clashes = staged(first.groupBy("node").agg(F.count("*").alias("n"), F.min("digest").alias("d")).where("n > 1").select("node", "d"), "clashes")
    if clashes.isEmpty():
        return first
    again = F.when(F.col("digest") != F.col("d"), F.xxhash64(F.lit(1), "digest")).otherwise(F.col("node"))
    return first.join(clashes, "node", "left").select("digest", "rep", again.alias("node"))


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (the smallest id that links reach) and kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text of fewer than five words is one shingle; without
    words (null, empty or blank) a document has no shingle and no link. Documents link from
    ``100 * common >= percent * union`` on. Rows that repeat an id are documents of their own, each linked by its text.
    A null id is never the smallest: only in a group without any other is component_id null, and kept true. Very long
    texts are compared whole, ties go to the smallest id, other columns are not read, an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    known = prints.where(F.col("digest").isNotNull())
    classes = staged(known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    numbered = _numbered(classes.select("digest", "rep"))
    heads = staged(classes.join(numbered.drop("rep"), "digest").select(F.col("node").alias("id"), "digest", "rep", "keys", "sketch"), "heads")
    dropped(classes)
    most = most_odd_bits(percent)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(id, set), a staged table, of the classes in nodes (id)."""
        wanted = staged(heads.select("id", "digest", "rep").join(nodes, "id", "left_semi"), "wanted")
        # a class is read from the rows of its smallest id; a null id's texts are looked for in all such rows
        texts = looked_up(docs.select(id_col, text_col), staged(wanted.select(F.col("rep").alias(id_col)).distinct(), "ids"), id_col, "left_semi")
        if not wanted.where("rep IS NULL").isEmpty():
            texts = texts.union(docs.select(id_col, text_col).where(F.col(id_col).isNull()))
        sets = _sets(texts, id_col, text_col).withColumnRenamed("id", "rep")
        sets = staged(sets.join(wanted.select("digest", F.col("id").alias("node"), F.col("rep").alias("r")), "digest").where("rep <=> r").select(F.col("node").alias("id"), "set").dropDuplicates(["id"]), "sets", "lz4")
        dropped(wanted)
        return sets

    def verify(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        found = staged(_confirmed(pairs, sets, percent), "confirmed")
        dropped(sets)
        return found

    def rare_shingles(nodes: DataFrame) -> DataFrame:
        sets = sets_of(nodes)
        found = staged(rarest(sets, counted(sets), percent), "rarest")
        dropped(sets)
        return found

    def common_enough(x: str, y: str) -> Column:
        """Both sides' places leave room for as many common shingles as a link has, and their sets are close enough."""
        x_size, y_size, x_at, y_at = (F.col(f"{side}{c}") for c in ("size", "at") for side in (x, y))
        room = F.least(x_size - x_at, y_size - y_at) * (100 + percent) >= percent * (x_size + y_size)
        return room & (_odd_bits(f"{x}bits", f"{y}bits", SET_BITS) <= most_set_bits(x_size, y_size, percent))

    def near(x: str, y: str) -> Column:
        """Sketches close enough."""
        return _odd_bits(f"{x}sketch", f"{y}sketch") <= most

    groups = linked(heads, verify, near, ["sketch"], Finer(rare_shingles, common_enough, ["at", "size", "bits"]))
    labelled = heads.select("id", "digest", "rep").join(groups, "id", "left").select("digest", "rep", F.coalesce("component", "id").alias("c"))
    least = labelled.groupBy("c").agg(F.min("rep").alias("component_id"))
    answers = labelled.join(least, "c").select("digest", "component_id", F.lit(True).alias("linked"))
    whole = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return prints.join(answers, "digest", "left").select(
        F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept")
    )
