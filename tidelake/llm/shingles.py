"""Vectorised hashing of words and shingles for a batch of texts."""

from __future__ import annotations

import numpy as np

SIZE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: bytes.translate table for words that end at ASCII white space: lower-cases A-Z, white space becomes a space.
WHITE_SPACE_WORDS = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_TABLES = [_powers(_ODD, 1 << 16), _powers(_INVERSE, 1 << 16)]


#: Bytes hashed at a time, cut at a space; the tables of powers get no longer than this or the longest word.
STRETCH = 1 << 20


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and each text's number of words.

    A word's hash is the value of its bytes as a polynomial, from prefix sums, then mixed with its length.
    """
    data, at, hashes, places = (b" ".join(texts) + b" ").translate(table), 0, [], []
    while at < len(data):
        end = min(len(data), at + STRETCH)
        if end < len(data):
            end = (data.rfind(b" ", at, end) + 1) or data.index(b" ", end) + 1
        starts, found = _hashed(np.frombuffer(data, np.uint8, end - at, at))
        places.append(starts + at)
        hashes.append(found)
        at = end
    bounds = np.cumsum([len(t) + 1 for t in texts])
    until = np.searchsorted(np.concatenate(places), bounds)
    return np.concatenate(hashes), np.diff(until, prepend=0)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes that end with a space."""
    while len(_TABLES[0]) < len(data):
        for k in (0, 1):
            further = _TABLES[k][-1:] * (_ODD, _INVERSE)[k]
            _TABLES[k] = np.concatenate([_TABLES[k], _TABLES[k] * further])
    letters = data != 32
    edges = np.flatnonzero(np.diff(letters, prepend=False))  # starts and ends in turn
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _TABLES[0][: len(data)], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * _TABLES[1][starts]
    return starts, mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words[:0]
    size_here = min(size, n)
    out = np.zeros(n - size_here + 1, np.uint64)
    for k in range(size_here):
        out = (out + words[k : n - size_here + 1 + k]) * _ODD
        out ^= out >> np.uint64(32)
    return mixed(out + np.uint64(size_here))


def shingle_sets(texts: list[bytes], table: bytes = WHITE_SPACE_WORDS, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts, table)
    ends = np.cumsum(counts)
    return [np.unique(shingle_hashes(words[e - c : e], size)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
