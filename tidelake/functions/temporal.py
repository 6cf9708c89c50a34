"""Calendar functions: extract, date_trunc and casts, with years counted without a year 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT_UNITS = (
    "millennium", "century", "decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second",
    "milliseconds", "microseconds",
)
TRUNC_UNITS = (
    "millennium", "century", "decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second",
    "milliseconds",
)


def _up(year: Column, size: int) -> Column:
    """Number of the period of ``size`` years: 1 for years 1 to size, -1 for the years before."""
    return F.when(year > 0, F.floor((year + size - 1) / size)).otherwise(-F.floor((size - 1 - (year - 1)) / size))


def extract(unit: str, ts: Column) -> Column:
    """The part of a timestamp as a double."""
    unit = unit.lower()
    if unit not in EXTRACT_UNITS:
        raise ValueError(f"extract does not support {unit!r}")
    year = F.year(ts)
    seconds = F.extract(F.lit("SECOND"), ts).cast("double")
    return {
        "millennium": lambda: _up(year, 1000),
        "century": lambda: _up(year, 100),
        "decade": lambda: F.floor(year / 10),
        "year": lambda: F.when(year > 0, year).otherwise(year - 1),
        "quarter": lambda: F.quarter(ts),
        "month": lambda: F.month(ts),
        "week": lambda: F.weekofyear(ts),
        "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: seconds,
        "milliseconds": lambda: F.extract(F.lit("SECOND"), ts) * 1000,
        "microseconds": lambda: F.extract(F.lit("SECOND"), ts) * 1_000_000,
    }[unit]().cast("double")


def date_trunc(unit: str, ts: Column) -> Column:
    """The start of the period a timestamp lies in: centuries and millennia start with year 1 of theirs."""
    unit = unit.lower()
    if unit not in TRUNC_UNITS:
        raise ValueError(f"date_trunc does not support {unit!r}")
    if unit not in ("millennium", "century", "decade"):
        return F.date_trunc("millisecond" if unit == "milliseconds" else unit, ts).cast("timestamp_ntz")
    size = {"millennium": 1000, "century": 100, "decade": 10}[unit]
    first = 0 if unit == "decade" else 1
    start = (F.floor((F.year(ts) - first) / size) * size + first).cast("int")
    one, zero = F.lit(1), F.lit(0)
    return F.when(ts.isNotNull(), F.make_timestamp_ntz(start, one, one, zero, zero, zero.cast("decimal(16,6)")))


def to_timestamp(ts: Column, shift_us: int = 0) -> Column:
    """timestamptz to timestamp: the wall clock of a zone that is a fixed number of microseconds from UTC."""
    from tidelake.functions.scalar import plus_micros

    return plus_micros(ts.cast("timestamp_ntz"), F.lit(-shift_us)) if shift_us else ts.cast("timestamp_ntz")


def to_timestamptz(ts: Column, shift_us: int = 0) -> Column:
    from tidelake.functions.scalar import plus_micros

    return (plus_micros(ts, F.lit(shift_us)) if shift_us else ts).cast("timestamp")


def to_date(ts: Column) -> Column:
    """The calendar day (rounded down, also before 1970)."""
    return F.to_date(ts)
