"""Scalar functions of the filter representation as Column builders.

Checked arithmetic relies on ANSI mode (overflow, division by zero and MIN / -1 raise); unchecked arithmetic wraps
around for integers. Everything stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.functions import temporal

INTS = {"int2": 16, "int4": 32, "int8": 64}
SPARK_TYPES = {
    "bool": "boolean",
    "int2": "smallint",
    "int4": "int",
    "int8": "bigint",
    "float4": "float",
    "float8": "double",
    "string": "string",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "time": "bigint",
}


def plus_micros(ts: Column, micros: Column) -> Column:
    """timestamp + microseconds, exact to the microsecond and independent of the session's zone."""
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def checked(op: Callable[[Column, Column], Column]):
    def build(args: list[Column], types: list[str]) -> Column:
        a, b = args
        if types[0] in ("timestamp", "timestamptz"):
            return plus_micros(a, b)
        return op(a, b).cast(SPARK_TYPES[types[0]])

    return build


def checked_divide(args: list[Column], types: list[str]) -> Column:
    a, b = args
    if types[0] not in INTS:
        return a / b
    low = F.lit(-(1 << INTS[types[0]] - 1))
    over = (a == low) & (b == -1)
    whole = F.call_function("div", a.cast("bigint"), b.cast("bigint"))
    return F.when(over, F.raise_error(F.lit("division overflow")).cast("bigint")).otherwise(whole).cast(SPARK_TYPES[types[0]])


def unchecked(symbol: str):
    """Two's complement for integers, plain for floats. Integer division by zero still raises."""

    def build(args: list[Column], types: list[str]) -> Column:
        a, b = args
        kind = types[0]
        if kind not in INTS:
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b) if kind == "numeric" else _float_divide(a, b)}[symbol]
        if symbol == "/":
            bits = INTS[kind]
            low = F.lit(-(1 << bits - 1)).cast(SPARK_TYPES[kind])
            whole = F.call_function("div", a.cast("bigint"), F.when((a == low) & (b == -1), F.lit(1)).otherwise(b).cast("bigint"))
            return whole.cast(SPARK_TYPES[kind])
        if kind == "int8":
            x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
            exact = {"+": x + y, "-": x - y, "*": x * y}[symbol].cast("decimal(38,0)")
            half = F.lit("9223372036854775808").cast("decimal(38,0)")
            wrapped = F.pmod(F.pmod(exact, half * 2) + half, half * 2) - half
            return wrapped.cast("bigint")
        x, y = a.cast("bigint"), b.cast("bigint")
        exact = {"+": x + y, "-": x - y, "*": x * y}[symbol]
        spare = 64 - INTS[kind]
        return F.shiftright(F.shiftleft(exact, spare), spare).cast(SPARK_TYPES[kind])

    return build


def _float_divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity or NaN instead of an error."""
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def one(f: Callable[[Column], Column], kind: str | None = None):
    def build(args: list[Column], types: list[str]) -> Column:
        out = f(args[0])
        return out.cast(kind) if kind else out

    return build


def same(f: Callable[[Column], Column]):
    return lambda args, types: f(args[0]).cast(SPARK_TYPES.get(types[0], "double"))


def _fixed_pattern(pattern: object) -> str:
    if not isinstance(pattern, str):
        raise ValueError("the pattern must be a string constant")
    if "\\" in pattern:
        raise ValueError("a backslash in a pattern is not supported")
    return pattern


def like(args: list, negated: bool = False, ignore_case: bool = False) -> Column:
    text, pattern = args[0], _fixed_pattern(args[1])
    out = text.ilike(pattern) if ignore_case else text.like(pattern)
    return ~out if negated else out


def trim(f):
    return lambda args, types: f(args[0]) if len(args) == 1 else f(args[0], args[1])


def substring(args: list[Column], types: list[str]) -> Column:
    start = args[1].cast("int")
    return F.substr(args[0], start) if len(args) == 2 else F.substr(args[0], start, args[2].cast("int"))


FUNCTIONS: dict[str, Callable[[list[Column], list[str]], Column]] = {
    "kLessThan": lambda a, t: a[0] < a[1],
    "kLessThanOrEqualTo": lambda a, t: a[0] <= a[1],
    "kGreaterThan": lambda a, t: a[0] > a[1],
    "kGreaterThanOrEqualTo": lambda a, t: a[0] >= a[1],
    "kEqual": lambda a, t: a[0] == a[1],
    "kNotEqual": lambda a, t: a[0] != a[1],
    "kIsNull": lambda a, t: a[0].isNull(),
    "kAddWithChecks": checked(lambda a, b: a + b),
    "kSubtractWithChecks": checked(lambda a, b: a - b),
    "kMultiplyWithChecks": checked(lambda a, b: a * b),
    "kDivideWithChecks": checked_divide,
    "kModuloWithChecks": checked(lambda a, b: a % b),
    "kAddWithoutChecks": unchecked("+"),
    "kSubtractWithoutChecks": unchecked("-"),
    "kMultiplyWithoutChecks": unchecked("*"),
    "kDivideWithoutChecks": unchecked("/"),
    "kBitwiseAnd": lambda a, t: a[0].bitwiseAND(a[1]),
    "kBitwiseOr": lambda a, t: a[0].bitwiseOR(a[1]),
    "kXor": lambda a, t: a[0].bitwiseXOR(a[1]),
    "kBitwiseNot": one(F.bitwise_not),
    "kAbsolute": same(F.abs),
    "kNegative": same(lambda c: -c),
    "kSign": same(F.signum),
    "kCeil": one(F.ceil, "double"),
    "kFloor": one(F.floor, "double"),
    "kRound": one(F.rint),
    "kSqrt": one(F.sqrt),
    "kCbrt": one(F.cbrt),
    "kExp": one(F.exp),
    "kLog10": one(F.log10),
    "kSin": one(F.sin),
    "kCos": one(F.cos),
    "kTan": one(F.tan),
    "kCot": one(F.cot),
    "kAtan": one(F.atan),
    "kAtan2": lambda a, t: F.atan2(a[0], a[1]),
    "kAsin": one(F.asin),
    "kAcos": one(F.acos),
    "kSinh": one(F.sinh),
    "kCosh": one(F.cosh),
    "kTanh": one(F.tanh),
    "kCastInt4": one(lambda c: c, "int"),
    "kCastInt8": one(lambda c: c, "bigint"),
    "kCastFloat8": one(lambda c: c, "double"),
    "kCharLength": one(F.char_length),
    "kLower": one(F.lower),
    "kUpper": one(F.upper),
    "kLTrim": trim(F.ltrim),
    "kRTrim": trim(F.rtrim),
    "kBTrim": trim(F.btrim),
    "kSubstring": substring,
    "kLocate": lambda a, t: F.position(a[1], a[0]),
    "kConcatenate": lambda a, t: F.concat(*a),
    "kCastDate": lambda a, t: temporal.to_date(a[0]),
    "kDateDiff": lambda a, t: F.date_diff(a[0], a[1]),
}
