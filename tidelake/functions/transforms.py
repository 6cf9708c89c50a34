"""Partition transforms: identity, bucket, truncate, year, month, day, hour, void."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C1, _C2, _M32 = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF


def _let(x: Column, body) -> Column:
    """body(x) with x computed once: a lambda variable keeps the expression from growing with every use of x."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _times32(x: Column, k: int) -> Column:
    """x * k modulo 2^32 for x in [0, 2^32): the factor goes in two halves so that products stay below 2^63."""
    return _let(
        x,
        lambda y: (F.shiftleft((y * (k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16) + y * (k & 0xFFFF)).bitwiseAND(F.lit(_M32)),
    )


def _rotl32(x: Column, r: int) -> Column:
    return _let(x, lambda y: F.shiftleft(y, r).bitwiseAND(F.lit(_M32)).bitwiseOR(F.shiftright(y, 32 - r)))


def _xor_shift(x: Column, r: int) -> Column:
    return _let(x, lambda y: y.bitwiseXOR(F.shiftright(y, r)))


def murmur3_long(value: Column) -> Column:
    """32-bit murmur3, seed 0, of the eight little-endian bytes of a long, as an unsigned number."""
    value = value.cast("bigint")
    h = F.lit(0).cast("bigint")
    for word in (value.bitwiseAND(F.lit(_M32)), F.shiftrightunsigned(value, 32)):
        h = h.bitwiseXOR(_times32(_rotl32(_times32(word, _C1), 15), _C2))
        h = (_rotl32(h, 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(_M32))
    h = h.bitwiseXOR(F.lit(8).cast("bigint"))
    h = _times32(_xor_shift(h, 16), 0x85EBCA6B)
    h = _times32(_xor_shift(h, 13), 0xC2B2AE35)
    return _xor_shift(h, 16)


def _byte(data: Column, at: Column | int) -> Column:
    return F.conv(F.hex(F.substr(data, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1))), 16, 10).cast("bigint")


def murmur3_bytes(data: Column) -> Column:
    """32-bit murmur3, seed 0, of a binary value, as an unsigned number."""
    size = F.octet_length(data)

    def block(h: Column, i: Column) -> Column:
        text = F.hex(F.substr(data, (i * 4 + 1).cast("int"), F.lit(4)))
        order = F.concat(*(F.substr(text, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)))
        word = F.conv(order, 16, 10).cast("bigint")
        h = h.bitwiseXOR(_times32(_rotl32(_times32(word, _C1), 15), _C2))
        return (_rotl32(h, 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(_M32))

    blocks = F.floor(size / 4).cast("int")
    whole = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(whole, F.lit(0).cast("bigint"), block)
    rest, at = size % 4, blocks * 4
    tail = F.lit(0).cast("bigint")
    for k in (2, 1, 0):
        tail = tail.bitwiseXOR(F.when(rest > k, F.shiftleft(_byte(data, at + k), 8 * k)).otherwise(F.lit(0).cast("bigint")))
    h = h.bitwiseXOR(_times32(_rotl32(_times32(tail, _C1), 15), _C2))
    h = h.bitwiseXOR(size.cast("bigint"))
    h = _times32(_xor_shift(h, 16), 0x85EBCA6B)
    h = _times32(_xor_shift(h, 13), 0xC2B2AE35)
    return _xor_shift(h, 16)


def _micros(value: Column, kind: T.DataType) -> Column:
    return F.unix_micros(value.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else value


def bucket(value: Column, n: int, kind: T.DataType) -> Column:
    """bucket[n]: integers and dates hash as longs, timestamps as microseconds, strings and binary as bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        h = murmur3_bytes(value.cast("binary"))
    elif isinstance(kind, T.DateType):
        h = murmur3_long(F.unix_date(value))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        h = murmur3_long(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        h = murmur3_long(_micros(value, kind))
    else:
        raise ValueError(f"bucket is not defined for {kind.simpleString()}")
    return F.when(value.isNotNull(), h.bitwiseAND(F.lit(0x7FFFFFFF)) % n).cast("int")


def truncate(value: Column, width: int, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.substring(value, 1, width)
    if isinstance(kind, T.BinaryType):
        return F.substr(value, F.lit(1), F.lit(width))
    if isinstance(kind, T.DecimalType):
        step = F.lit(width) * F.lit(10 ** -kind.scale if kind.scale <= 0 else 1).cast(kind) if kind.scale <= 0 else F.expr(f"CAST({width}e-{kind.scale} AS DECIMAL(38,{kind.scale}))")
        return (value - F.pmod(value, step)).cast(kind)
    return (value - F.pmod(value, F.lit(width))).cast(kind)


def apply(transform: str, value: Column, kind: T.DataType) -> Column:
    """The transform by its name in a partition spec: periods count from 1970 (days as dates)."""
    if m := re.fullmatch(r"(bucket|truncate)\[(\d+)\]", transform):
        n = int(m[2])
        if not n:
            raise ValueError(f"{transform}: the parameter must be positive")
        return bucket(value, n, kind) if m[1] == "bucket" else truncate(value, n, kind)
    if transform == "identity":
        return value
    if transform == "void":
        return F.lit(None).cast("int")
    if transform not in ("year", "month", "day", "hour"):
        raise ValueError(f"unknown transform {transform!r}")
    if transform == "year":
        return F.year(value) - 1970
    if transform == "month":
        return (F.year(value) - 1970) * 12 + F.month(value) - 1
    if transform == "day":
        return F.to_date(value)
    return F.floor(_micros(value, kind) / 3_600_000_000).cast("int")


def partition_path(names: list[str], values: list[Column]) -> Column:
    """Hive-style path of a partition; null values have Hive's name for them."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(v.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for n, v in zip(names, values, strict=True)]
    return F.concat_ws("/", *parts)
