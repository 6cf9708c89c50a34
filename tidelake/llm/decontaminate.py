"""Benchmark decontamination: SimHash of word windows, multi-index Hamming lookup, weighted-shingle check.

Every benchmark item gives windows of SIZE of its own words, as long as a shingle: so many, the heaviest first, that
what is left of its weight is less than the similarity asked for. A stretch that reaches the similarity shares at least
one of them, whatever the edits are. Documents are read once; at every word, the SimHash of the window is computed from
running sums of word-hash bits. Fingerprints are cut into RADIUS + 1 blocks; a window whose distance to an item's is at
most RADIUS has a block in common with it, so looking up all blocks finds every such pair. A candidate is settled on
the words themselves: the weighted Jaccard similarity of 5-word shingles of the item and of any stretch of its length
around the window, a shingle's weight being its inverse document frequency in the whole benchmark.

The benchmark is the query set: it is taken in blocks of ``BLOCK`` items, each of which goes to all tasks, with the
weights that its shingles have in all blocks.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import WORDS_ONLY, map_texts, staged, text_or_empty
from tidelake.llm.shingles import SIZE, word_hashes

RADIUS, BLOCKS, BLOCK = 3, 4, 5000
#: Words whose window sums are held at a time; 64 bytes each.
STRETCH = 4096


def window_prints(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """size -> SimHash (uint64) of the window that starts at each word and lies inside the sequence."""
    found: dict[int, list[np.ndarray]] = {s: [] for s in sizes}
    most = max(sizes)
    for at in range(0, len(words), STRETCH):
        part = np.ascontiguousarray(words[at : at + STRETCH + most - 1])
        sums = {1: np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)}
        double = 1
        while double * 2 <= min(most, len(part)):
            x = sums[double]
            sums[double * 2] = x[:-double] + x[double:]
            double *= 2
        for size in sizes:
            n = min(STRETCH, len(part) - size + 1)
            if n <= 0:
                continue
            total, offset = None, 0
            for power in sorted(sums, reverse=True):
                if power & size:
                    x = sums[power][offset : offset + n]
                    total = x if total is None else total + x
                    offset += power
            found[size].append(np.packbits(total > size // 2, axis=1).view(np.uint64).ravel())
    return {s: np.concatenate(x) if x else np.zeros(0, np.uint64) for s, x in found.items()}


class ItemIndex:
    """Items with ids; words are bytes. Items without a word are left out.

    Where these are a part of the benchmark, ``n`` is its number of items and ``df`` tells how many of them hold a
    shingle; one that isn't in it is in one item at most.
    """

    def __init__(
        self,
        items: list[tuple[object, bytes]],
        similarity: float,
        df: dict[tuple[bytes, ...], int] | None = None,
        n: int | None = None,
    ):
        self.similarity = similarity
        self.items = [(i, w) for i, t in items if (w := t.translate(WORDS_ONLY).split())]
        self.shingles = [Counter(self._shingles(w)) for _, w in self.items]
        df = Counter(s for x in self.shingles for s in x) if df is None else df
        n = len(self.items) if n is None else n
        self.weight = {s: math.log(1 + n / k) for s, k in df.items()}
        self.unknown = math.log(1 + n) if n else 1.0
        self.weight |= {s: self.unknown for x in self.shingles for s in x if s not in df}
        self.totals = [sum(self.weight[s] * k for s, k in x.items()) for x in self.shingles]
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            hashes, _ = word_hashes([b" ".join(words)], WORDS_ONLY)
            size = min(len(words), SIZE)
            prints = window_prints(hashes, [size])[size]
            for at in self.anchors(k):
                entries.setdefault(size, []).append((int(prints[at]), k, at))
        self.sizes = sorted(entries)
        self.tables = {}
        for size, rows in entries.items():
            prints = np.array([r[0] for r in rows], np.uint64)
            blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
            orders = [np.argsort(blocks[:, b], kind="stable") for b in range(BLOCKS)]
            ends = [np.cumsum(np.bincount(blocks[:, b], minlength=1 << 16)) for b in range(BLOCKS)]
            self.tables[size] = (prints, orders, ends, rows)

    def anchors(self, item: int) -> list[int]:
        """Places of the shingles without which no stretch reaches the similarity; of equal weights the longest first."""
        shingles, out, gone = self.shingles[item], [], 0.0
        first = {s: at for at, s in reversed([*enumerate(self._shingles(self.items[item][1]))])}
        for s in sorted(shingles, key=lambda s: (-self.weight[s], -sum(map(len, s)), s)):
            out.append(first[s])
            gone += self.weight[s] * shingles[s]
            if gone > (1 - self.similarity + 1e-9) * self.totals[item]:
                break
        return out

    @staticmethod
    def _shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
        return [tuple(words[k : k + SIZE]) for k in range(max(1, len(words) - SIZE + 1))]

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows and the entries within RADIUS of them: exactly all such pairs."""
        known, orders, ends, _ = self.tables[size]
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        places, entries = [], []
        for b in range(BLOCKS):
            counts = np.diff(ends[b], prepend=0)[blocks[:, b]]
            at = np.flatnonzero(counts)
            counts = counts[at]
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = orders[b][np.repeat(ends[b][blocks[at, b]] - counts, counts) + inside]
            at = np.repeat(at, counts)
            near = np.bitwise_count(known[rows] ^ prints[at]) <= RADIUS
            places.append(at[near])
            entries.append(rows[near])
        return np.concatenate(places), np.concatenate(entries)

    def similar(self, words: list[bytes], start: int, item: int) -> float:
        """Weighted Jaccard similarity of an item and the stretch of its length at start."""
        n = len(self.items[item][1])
        if start < 0 or start >= len(words):
            return 0.0
        mine, here = self.shingles[item], Counter(self._shingles(words[start : start + n]))
        weight = lambda s: self.weight.get(s, self.unknown)
        common = sum(weight(s) * min(k, here[s]) for s, k in mine.items() if s in here)
        return common / (sum(weight(s) * k for s, k in mine.items()) + sum(weight(s) * k for s, k in here.items()) - common)

    def best(self, words: list[bytes], pointed: int, item: int) -> tuple[float, int]:
        """The best similarity of the stretches around the one pointed to, and its start; 0 where none reaches it."""
        n, mine = len(self.items[item][1]), self.shingles[item]
        size = min(n, SIZE)
        low, high = max(0, pointed - (n - size)), min(len(words) - size, pointed + n - size)
        grams = [tuple(words[k : k + size]) for k in range(low, min(high + n, len(words)) - size + 1)]
        least = self.similarity - 1e-9
        known = Counter(g for g in grams if g in mine)
        if sum(self.weight[g] * min(k, mine[g]) for g, k in known.items()) < least * self.totals[item]:
            return 0.0, pointed
        # running sums tell which starts are worth an exact sum
        weights = [self.weight.get(g, self.unknown) for g in grams]
        here: Counter[tuple[bytes, ...]] = Counter()
        total = common = 0.0
        first = end = 0
        rough = []
        for start in range(low, high + 1):
            while end < len(grams) and end + low + size <= start + n:
                g = grams[end]
                total += weights[end]
                if here[g] < mine.get(g, 0):
                    common += weights[end]
                here[g] += 1
                end += 1
            while first + low < start:
                g = grams[first]
                total -= weights[first]
                here[g] -= 1
                if here[g] < mine.get(g, 0):
                    common -= weights[first]
                first += 1
            rough.append((common / (self.totals[item] + total - common), start))
        least = max(least, max(rough)[0] - 1e-9)
        exact = [(self.similar(words, s, item), -abs(s - pointed), s) for value, s in rough if value >= least]
        if not exact:
            return 0.0, pointed
        value, _, start = max(exact)
        return value, start

    def search(self, texts: list[bytes]) -> list[dict[int, tuple[float, int]]]:
        """For each text: item number -> (best similarity, its start in words)."""
        hashes, counts = word_hashes(texts, WORDS_ONLY)
        ends = np.cumsum(counts)
        found: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        if not self.items or not len(hashes):
            return found
        wanted: dict[int, set[tuple[int, int]]] = {}
        for size, prints in window_prints(hashes, self.sizes).items():
            places, entries = self.candidates(prints, size)
            doc = np.searchsorted(ends, places, "right")
            inside = places + size <= ends[np.minimum(doc, len(ends) - 1)]
            rows = self.tables[size][3]
            for at, e, d in zip(places[inside].tolist(), entries[inside].tolist(), doc[inside].tolist(), strict=True):
                _, item, offset = rows[e]
                wanted.setdefault(d, set()).add((item, at - int(ends[d] - counts[d]) - offset))
        for d, pairs in wanted.items():
            words = texts[d].translate(WORDS_ONLY).split()
            for item, start in sorted(pairs):
                value, at = self.best(words, start, item)
                old = found[d].get(item)
                if value >= self.similarity and (old is None or (value, -at) > (old[0], -old[1])):
                    found[d][item] = (value, at)
        return found


def _frequencies(benchmark: DataFrame, item_text_col: str) -> tuple[dict[tuple[bytes, ...], int], int]:
    """Shingles that several items of the whole benchmark hold, with their number of items; number of items with a word."""

    def rows():
        def of(ids, texts):
            words = [t.translate(WORDS_ONLY).split() for t in texts]
            return {"s": [[b" ".join(s) for s in {*ItemIndex._shingles(w)}] if w else [] for w in words]}

        return of

    source = benchmark.select(F.lit(0).alias("i"), F.col(item_text_col).alias("t"))
    held = staged(map_texts(source, "i", "t", rows, "s array<binary>"), "shingles")
    several = held.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    return {tuple(bytes(r.s).split()): r.n for r in several.toLocalIterator()}, held.where("size(s) > 0").count()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id_col, item_col, similarity, first_word): every document and item that it holds, with the best place.

    Null and empty texts hold nothing; items without a word are never found. Items that repeat are items of their own.
    Without items, or documents, there are no rows. Texts are compared as lower-case words without punctuation.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind.simpleString()}, hits array<struct<item: {item_kind}, similarity: double, first_word: long>>"
    out = None
    items = benchmark.select(F.col(item_col).alias("i"), text_or_empty(item_text_col).cast("binary").alias("t"))
    block: list[tuple[object, bytes]] = []
    df, n_items = _frequencies(benchmark, item_text_col)

    def passed(block: list[tuple[object, bytes]]) -> DataFrame:
        index = ItemIndex(block, similarity, df, n_items)

        def rows():
            def of(ids, texts):
                hits = []
                for at in range(0, len(texts), 200):
                    for x in index.search(texts[at : at + 200]):
                        hits.append(
                            [
                                {"item": index.items[k][0], "similarity": v, "first_word": place}
                                for k, (v, place) in sorted(x.items())
                            ]
                        )
                return {"id": ids, "hits": hits}

            return of

        return map_texts(docs, id_col, text_col, rows, schema)

    for row in items.toLocalIterator():
        block.append((row.i, bytes(row.t)))
        if len(block) == BLOCK:
            out, block = passed(block) if out is None else out.unionByName(passed(block)), []
    if block:
        out = passed(block) if out is None else out.unionByName(passed(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select("id", F.explode("hits").alias("h")).select(
        F.col("id").alias(id_col), F.col("h.item").alias(item_col), F.col("h.similarity").alias("similarity"), F.col("h.first_word").alias("first_word")
    )
