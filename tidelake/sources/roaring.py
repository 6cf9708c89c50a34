"""64-bit Roaring bitmaps in the portable format, and the deletion-vector blob around them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

NO_RUNS, WITH_RUNS = 12346, 12347
DV_MAGIC = bytes((0xD1, 0xD3, 0x39, 0x64))


class BitmapError(ValueError):
    """Bytes that are no valid bitmap or blob."""


def _encode32(values: np.ndarray) -> bytes:
    """values: sorted distinct, below 2^32. Containers: arrays up to 4096 values, bitmaps above, runs where smaller."""
    high = (values >> 16).astype(np.int64)
    keys, starts = np.unique(high, return_index=True)
    parts, runs = [], []
    for k, group in zip(keys.tolist(), np.split((values & 0xFFFF).astype(np.int64), starts[1:]), strict=True):
        edges = np.flatnonzero(np.diff(group) != 1)
        firsts = group[np.concatenate([[0], edges + 1])]
        lengths = group[np.concatenate([edges, [len(group) - 1]])] - firsts
        plain = 2 * len(group) if len(group) <= 4096 else 8192
        run = 2 + 4 * len(firsts) < plain
        if run:
            body = struct.pack("<H", len(firsts)) + np.stack([firsts, lengths], 1).astype("<u2").tobytes()
        elif len(group) <= 4096:
            body = group.astype("<u2").tobytes()
        else:
            bits = np.zeros(65536, np.uint8)
            bits[group] = 1
            body = np.packbits(bits, bitorder="little").tobytes()
        parts.append((k, len(group), body))
        runs.append(run)
    n = len(parts)
    descriptions = b"".join(struct.pack("<HH", k, size - 1) for k, size, _ in parts)
    if any(runs):
        head = struct.pack("<I", WITH_RUNS | (n - 1) << 16) + np.packbits(np.array(runs, np.uint8), bitorder="little").tobytes()
        offsets = n >= 4
    else:
        head, offsets = struct.pack("<II", NO_RUNS, n), True
    out, at = [], len(head) + len(descriptions) + 4 * n * offsets
    for _, _, body in parts:
        out.append(struct.pack("<I", at))
        at += len(body)
    return head + descriptions + (b"".join(out) if offsets else b"") + b"".join(b for _, _, b in parts)


def _decode32(data: memoryview) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", data, 0)
    at = 4
    if cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data[at : at + (n + 7) // 8], np.uint8), bitorder="little")[:n]
        at += (n + 7) // 8
        offsets = n >= 4
    elif cookie == NO_RUNS:
        (n,) = struct.unpack_from("<I", data, at)
        at, runs, offsets = at + 4, np.zeros(n, np.uint8), True
    else:
        raise BitmapError(f"unknown bitmap cookie {cookie}")
    described = np.frombuffer(data[at : at + 4 * n], "<u2").reshape(-1, 2)
    at += 4 * n + (4 * n if offsets else 0)
    out = []
    for (key, last), run in zip(described.tolist(), runs.tolist(), strict=True):
        if run:
            (k,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data[at + 2 : at + 2 + 4 * k], "<u2").reshape(-1, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs.tolist()]) if k else np.zeros(0, np.int64)
            at += 2 + 4 * k
        elif last + 1 <= 4096:
            low = np.frombuffer(data[at : at + 2 * (last + 1)], "<u2").astype(np.int64)
            at += 2 * (last + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + 8192], np.uint8), bitorder="little"))
            at += 8192
        if len(low) != last + 1:
            raise BitmapError("a container's cardinality is wrong")
        out.append(low + (key << 16))
    return np.concatenate(out) if out else np.zeros(0, np.int64), at


def encode(positions: Iterable[int]) -> bytes:
    values = np.unique(np.fromiter(positions, np.int64))
    if len(values) and values[0] < 0:
        raise BitmapError("positions must not be negative")
    high = values >> 32
    keys, starts = np.unique(high, return_index=True)
    groups = np.split(values & 0xFFFFFFFF, starts[1:]) if len(values) else []
    return struct.pack("<Q", len(keys)) + b"".join(struct.pack("<I", k) + _encode32(g) for k, g in zip(keys.tolist(), groups, strict=True))


def decode(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data, 0)
    at, out = 8, []
    for _ in range(n):
        (key,) = struct.unpack_from("<I", data, at)
        values, used = _decode32(memoryview(data)[at + 4 :])
        out.append(values + (key << 32))
        at += 4 + used
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def vector_blob(positions: Iterable[int]) -> bytes:
    """length (big-endian) of what follows up to the checksum, magic, bitmap, CRC-32 of magic and bitmap (big-endian)."""
    body = DV_MAGIC + encode(positions)
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def read_vector_blob(blob: bytes) -> np.ndarray:
    if len(blob) < 12:
        raise BitmapError("the blob is too short")
    (n,) = struct.unpack_from(">I", blob, 0)
    body = blob[4 : 4 + n]
    if len(blob) != n + 8 or body[:4] != DV_MAGIC:
        raise BitmapError("not a deletion vector")
    if struct.unpack_from(">I", blob, 4 + n)[0] != zlib.crc32(body):
        raise BitmapError("wrong checksum")
    return decode(body[4:])
