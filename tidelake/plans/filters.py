"""Filter expressions: a small tree, its JSON form, and its compilation to a Column.

JSON nodes: var, const, func, funcarr (scalar ANY / ALL array), if, logical. Compiling gives one Catalyst expression,
so filters are pushed into scans like any written by hand.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions import scalar, temporal

VALUE_TYPES = (
    "bool", "int2", "int4", "int8", "float4", "float8", "numeric", "string", "date", "timestamp", "timestamptz", "time",
    "interval",
)
COMPARISONS = ("kLessThan", "kLessThanOrEqualTo", "kGreaterThan", "kGreaterThanOrEqualTo", "kEqual", "kNotEqual")
_WIDER = {"int2": 0, "int4": 1, "int8": 2, "float4": 3, "float8": 4}
_BY_UNIT = ("kExtractTimestamp", "kDateTrunc")


class FilterError(ValueError):
    """A filter that isn't well formed or not supported."""


@dataclass(frozen=True)
class Variable:
    type: str
    name: str


@dataclass(frozen=True)
class Const:
    type: str
    value: object


@dataclass(frozen=True)
class Function:
    id: str
    arg_types: tuple[str, ...]
    type: str
    args: tuple = ()


@dataclass(frozen=True)
class ArrayFunction:
    """lhs op ANY (use_or) or ALL (array)."""

    id: str
    arg_types: tuple[str, ...]
    use_or: bool
    lhs: object
    array_type: str
    array: tuple
    type: str = field(default="bool")


@dataclass(frozen=True)
class If:
    cond: object
    then: object
    otherwise: object


@dataclass(frozen=True)
class Logical:
    op: str
    args: tuple
    type: str = field(default="bool")


def type_of(node) -> str:
    if isinstance(node, If):
        return type_of(node.then)
    return node.type


def children(node) -> tuple:
    if isinstance(node, (Function, Logical)):
        return node.args
    if isinstance(node, ArrayFunction):
        return (node.lhs,)
    return (node.cond, node.then, node.otherwise) if isinstance(node, If) else ()


def columns(node) -> set[str]:
    """Names of all columns that the filter reads."""
    return {node.name} if isinstance(node, Variable) else set().union(*map(columns, children(node)), set())


def _get(x: object, key: str, kind: type | tuple = object):
    if not isinstance(x, dict) or key not in x:
        raise FilterError(f"missing {key!r}")
    if not isinstance(x[key], kind):
        raise FilterError(f"wrong type of {key!r}")
    return x[key]


def _value_type(x: object) -> str:
    if x not in VALUE_TYPES:
        raise FilterError(f"unknown value type {x!r}")
    return x


def _checked_value(kind: str, value: object) -> object:
    ok = {
        "bool": lambda v: isinstance(v, bool),
        "float4": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        "float8": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        "numeric": lambda v: isinstance(v, str),
        "string": lambda v: isinstance(v, str),
        "interval": lambda v: isinstance(v, dict) and set(v) == {"months", "micros"},
    }.get(kind, lambda v: isinstance(v, int) and not isinstance(v, bool))
    if value is not None and not ok(value):
        raise FilterError(f"{value!r} is no {kind}")
    return value


def _load(x: object):
    kind = _get(x, "node-type", str)
    if kind == "var":
        return Variable(_value_type(_get(x, "val-type")), _get(x, "col-name", str))
    if kind == "const":
        v = _get(x, "value", dict)
        t = _value_type(_get(v, "val-type"))
        return Const(t, _checked_value(t, _get(v, "value")))
    if kind in ("func", "funcarr"):
        s = _get(x, "func-sig", dict)
        types = tuple(_value_type(t) for t in _get(s, "arg-types", list))
        name, out = _get(s, "func-id", str), _value_type(_get(s, "val-type"))
        if name not in scalar.FUNCTIONS and name not in _SPECIAL:
            raise FilterError(f"unknown function {name!r}")
        if kind == "func":
            return Function(name, types, out, tuple(_load(a) for a in _get(x, "args", list)))
        a = _get(x, "rhs", dict)
        t = _value_type(_get(a, "val-type"))
        values = tuple(_checked_value(t, v) for v in _get(a, "value", list))
        return ArrayFunction(name, types, _get(x, "use-or", bool), _load(_get(x, "lhs")), t, values, out)
    if kind == "if":
        return If(*(_load(_get(x, k)) for k in ("cond", "then", "else")))
    if kind == "logical":
        op = _get(x, "logic-op", str)
        args = tuple(_load(a) for a in _get(x, "args", list))
        if op not in ("kAnd", "kOr", "kNot") or (op == "kNot" and len(args) != 1) or not args:
            raise FilterError(f"wrong logical node {op!r} of {len(args)}")
        return Logical(op, args)
    raise FilterError(f"unknown node type {kind!r}")


_SPECIAL = ("kLike", "kNotLike", "kILike", "kNotILike", "kExtractTimestamp", "kDateTrunc", "kCastTimestamp", "kCastTimestamptz")


def from_json(text: str):
    """The tree of a filter; an empty text is no filter (None)."""
    if not text:
        return None
    try:
        return _load(json.loads(text))
    except json.JSONDecodeError as e:
        raise FilterError(str(e)) from e


def _dump(node) -> dict:
    if isinstance(node, Variable):
        return {"node-type": "var", "val-type": node.type, "col-name": node.name}
    if isinstance(node, Const):
        return {"node-type": "const", "value": {"val-type": node.type, "value": node.value}}
    if isinstance(node, If):
        return {"node-type": "if", "cond": _dump(node.cond), "then": _dump(node.then), "else": _dump(node.otherwise)}
    if isinstance(node, Logical):
        return {"node-type": "logical", "logic-op": node.op, "args": [_dump(a) for a in node.args]}
    signature = {"arg-types": list(node.arg_types), "val-type": node.type, "func-id": node.id}
    if isinstance(node, Function):
        return {"node-type": "func", "func-sig": signature, "args": [_dump(a) for a in node.args]}
    return {
        "node-type": "funcarr",
        "func-sig": signature,
        "use-or": node.use_or,
        "lhs": _dump(node.lhs),
        "rhs": {"val-type": node.array_type, "value": list(node.array)},
    }


def to_json(node) -> str:
    return "" if node is None else json.dumps(_dump(node), separators=(",", ":"), ensure_ascii=False)


def literal(kind: str, value: object) -> Column:
    if kind == "numeric":
        if value is None:
            return F.lit(None).cast("decimal(38,0)")
        d = Decimal(value)
        return F.lit(d if d.as_tuple().exponent <= 0 else d.quantize(Decimal(1)))
    if kind == "interval":
        if value is None:
            return F.expr("CAST(NULL AS INTERVAL DAY TO SECOND)")
        if value["months"]:
            raise FilterError("intervals of months are not supported")
        return F.lit(timedelta(microseconds=value["micros"]))
    if value is not None and kind == "date":
        value = date(1970, 1, 1) + timedelta(days=value)
    if value is not None and kind == "timestamp":
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=value))).cast("timestamp_ntz")
    if value is not None and kind == "timestamptz":
        return F.timestamp_micros(F.lit(value).cast("bigint"))
    return F.lit(value).cast(scalar.SPARK_TYPES[kind])


class Compiler:
    """Compiles trees against a frame's columns: names ignore case, and a column that isn't there is a typed null."""

    def __init__(self, df: DataFrame, shift_us: int = 0):
        self.names = {n.lower(): n for n in df.columns}
        self.shift = shift_us

    def column(self, node) -> Column:
        if isinstance(node, Variable):
            name = self.names.get(node.name.lower())
            if name is None:
                return literal(node.type, None)
            return F.col(f"`{name}`")
        if isinstance(node, Const):
            return literal(node.type, node.value)
        if isinstance(node, Logical):
            args = [self.column(a) for a in node.args]
            if node.op == "kNot":
                return ~args[0]
            out = args[0]
            for a in args[1:]:
                out = out & a if node.op == "kAnd" else out | a
            return out
        if isinstance(node, If):
            if type_of(node.then) != type_of(node.otherwise):
                raise FilterError("both branches of an if must have one type")
            return F.when(self.column(node.cond), self.column(node.then)).otherwise(self.column(node.otherwise))
        if isinstance(node, ArrayFunction):
            return self._over_array(node)
        return self._call(node)

    def _call(self, node: Function) -> Column:
        if node.id in ("kLike", "kNotLike", "kILike", "kNotILike"):
            pattern = node.args[1].value if isinstance(node.args[1], Const) else None
            return scalar.like([self.column(node.args[0]), pattern], "Not" in node.id, "ILike" in node.id)
        if node.id in _BY_UNIT:
            unit = node.args[0].value if isinstance(node.args[0], Const) else None
            if not isinstance(unit, str):
                raise FilterError("the unit must be a string constant")
            f = temporal.extract if node.id == "kExtractTimestamp" else temporal.date_trunc
            return f(unit, self.column(node.args[1]))
        args, types = [self.column(a) for a in node.args], [type_of(a) for a in node.args]
        if node.id == "kCastTimestamp":
            return temporal.to_timestamp(args[0], self.shift)
        if node.id == "kCastTimestamptz":
            return temporal.to_timestamptz(args[0], self.shift)
        args, types = self._promoted(node.id, args, types)
        return scalar.FUNCTIONS[node.id](args, types)

    def _promoted(self, name: str, args: list[Column], types: list[str]) -> tuple[list[Column], list[str]]:
        if len(args) != 2 or types[0] == types[1]:
            return args, types
        if types[0] in _WIDER and types[1] in _WIDER:
            wide = max(types, key=_WIDER.get)
            return [a.cast(scalar.SPARK_TYPES[wide]) for a in args], [wide, wide]
        if name in COMPARISONS:
            plain = [temporal.to_timestamp(a, self.shift) if t == "timestamptz" else a.cast("timestamp_ntz") if t == "date" else a for a, t in zip(args, types, strict=True)]
            return plain, ["timestamp" if t in ("timestamptz", "date") else t for t in types]
        return args, types

    def _over_array(self, node: ArrayFunction) -> Column:
        if not node.array:
            raise FilterError("the array must not be empty")
        lhs = self.column(node.lhs)
        known = [v for v in node.array if v is not None]
        plain = len(known) == len(node.array) and type_of(node.lhs) == node.array_type
        if plain and (node.id, node.use_or) in (("kEqual", True), ("kNotEqual", False)):
            found = lhs.isin([literal(node.array_type, v) for v in known])
            return found if node.use_or else ~found
        out = None
        for v in node.array:
            args, types = self._promoted(node.id, [lhs, literal(node.array_type, v)], [type_of(node.lhs), node.array_type])
            if node.id in ("kLike", "kNotLike", "kILike", "kNotILike"):
                one = scalar.like([lhs, v], "Not" in node.id, "ILike" in node.id)
            else:
                one = scalar.FUNCTIONS[node.id](args, types)
            out = one if out is None else out | one if node.use_or else out & one
        return out


def compile_filter(df: DataFrame, text_or_node, shift_us: int = 0) -> Column:
    """The filter as a boolean Column; no filter is true."""
    node = from_json(text_or_node) if isinstance(text_or_node, str) else text_or_node
    return F.lit(True) if node is None else Compiler(df, shift_us).column(node)


# ---- builders for filters written in Python


def var(name: str, kind: str) -> Variable:
    return Variable(kind, name)


def const(kind: str, value: object) -> Const:
    return Const(kind, value)


def call(name: str, *args, type: str = "bool") -> Function:  # noqa: A002
    return Function(name, tuple(type_of(a) for a in args), type, args)


def both(*args) -> Logical:
    return Logical("kAnd", args)


def either(*args) -> Logical:
    return Logical("kOr", args)


def no(arg) -> Logical:
    return Logical("kNot", (arg,))


def over(name: str, lhs, kind: str, values: list, any_: bool = True) -> ArrayFunction:
    return ArrayFunction(name, (type_of(lhs), kind), any_, lhs, kind, tuple(values))
