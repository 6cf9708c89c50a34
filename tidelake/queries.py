"""The engine's own queries over the driver's tables, with their DuckDB equivalents.

Each query goes through the operators: filters are trees compiled from their JSON form, deletes are the anti-joins of
``operators.deletes``, statistics those of ``operators.stats``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import temporal, transforms
from tidelake.operators import deletes, stats
from tidelake.plans import filters as f
from tidelake.plans import planning
from tidelake.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


# ---- filters: each one is a tree, serialised to JSON and compiled from it

QTY, PRICE = f.var("l_quantity", "float8"), f.var("l_extendedprice", "float8")
LINE, SHIP = f.var("l_linenumber", "int4"), f.var("l_shipdate", "timestamp")
TOTAL, ORDERED = f.var("o_totalprice", "float8"), f.var("o_orderdate", "timestamp")
_DAY = 86_400_000_000


def filter_query(name: str, of: str, keep: list[str], node, where: str) -> None:
    text = f.to_json(node)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        return df.where(f.compile_filter(df, text)).select(*keep)

    query(name, f"SELECT {', '.join(keep)} FROM {of} WHERE {where}")(run)


_LI, _PT = ["l_orderkey", "l_linenumber"], ["p_partkey"]
for _name, _id, _op in [
    ("filter_lt", "kLessThan", "<"),
    ("filter_le", "kLessThanOrEqualTo", "<="),
    ("filter_gt", "kGreaterThan", ">"),
    ("filter_ge", "kGreaterThanOrEqualTo", ">="),
    ("filter_eq", "kEqual", "="),
    ("filter_ne", "kNotEqual", "<>"),
]:
    filter_query(_name, "lineitem", _LI, f.call(_id, QTY, f.const("float8", 24.0)), f"l_quantity {_op} 24")
filter_query("filter_is_null", "events", ["event_id"], f.call("kIsNull", f.var("value", "float8")), "value IS NULL")
filter_query("filter_missing_column", "nation", ["n_nationkey"], f.call("kIsNull", f.var("absent", "int4")), "true")
for _name, _id, _sql in [
    ("filter_like", "kLike", "p_name LIKE '%ring%'"),
    ("filter_not_like", "kNotLike", "p_name NOT LIKE '%ring%'"),
]:
    filter_query(_name, "part", _PT, f.call(_id, f.var("p_name", "string"), f.const("string", "%ring%")), _sql)
for _name, _id, _sql in [
    ("filter_ilike", "kILike", "p_type ILIKE '%s_a%'"),
    ("filter_not_ilike", "kNotILike", "p_type NOT ILIKE '%s_a%'"),
]:
    filter_query(_name, "part", _PT, f.call(_id, f.var("p_type", "string"), f.const("string", "%s_a%")), _sql)
filter_query(
    "filter_and_or_not",
    "lineitem",
    _LI,
    f.either(
        f.both(f.call("kLessThan", QTY, f.const("float8", 10.0)), f.call("kGreaterThan", PRICE, f.const("float8", 5000.0))),
        f.no(f.call("kLessThanOrEqualTo", LINE, f.const("int4", 3))),
    ),
    "(l_quantity < 10 AND l_extendedprice > 5000) OR NOT (l_linenumber <= 3)",
)
filter_query(
    "filter_if",
    "lineitem",
    _LI,
    f.call("kGreaterThan", f.If(f.call("kEqual", LINE, f.const("int4", 1)), QTY, f.var("l_tax", "float8")), f.const("float8", 0.05)),
    "CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_tax END > 0.05",
)
_SIZE = f.var("p_size", "int4")
filter_query("filter_any", "part", _PT, f.over("kLessThan", _SIZE, "int4", [5, 12, 3]), "p_size < 5 OR p_size < 12 OR p_size < 3")
filter_query("filter_all", "part", _PT, f.over("kGreaterThan", _SIZE, "int4", [5, 12], any_=False), "p_size > 5 AND p_size > 12")
filter_query("filter_in", "part", _PT, f.over("kEqual", _SIZE, "int4", [1, 7, 23]), "p_size IN (1, 7, 23)")
filter_query("filter_in_null", "part", _PT, f.over("kEqual", _SIZE, "int4", [1, None, 23]), "p_size IN (1, NULL, 23)")
filter_query("filter_not_in", "part", _PT, f.over("kNotEqual", _SIZE, "int4", [1, 7], any_=False), "p_size NOT IN (1, 7)")
filter_query("filter_not_in_null", "part", _PT, f.over("kNotEqual", _SIZE, "int4", [1, None], any_=False), "p_size NOT IN (1, NULL)")
filter_query(
    "filter_from_json",
    "lineitem",
    _LI,
    f.both(f.call("kGreaterThanOrEqualTo", SHIP, f.const("timestamp", 9131 * _DAY)), f.call("kLessThan", f.var("L_DISCOUNT", "float8"), f.const("float8", 0.05))),
    "l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount < 0.05",
)
filter_query("cmp_date_timestamp", "orders", ["o_orderkey"], f.call("kGreaterThan", f.const("date", 10000), ORDERED), "DATE '1997-05-19' > o_orderdate")
filter_query(
    "cmp_promoted", "lineitem", _LI, f.call("kEqual", LINE, f.const("int8", 2)), "l_linenumber = 2"
)
filter_query(
    "filter_numeric", "customer", ["c_custkey"],
    f.call("kGreaterThan", f.call("kCastInt8", f.var("c_acctbal", "float8"), type="int8"), f.const("int8", 100)),
    "trunc(c_acctbal) > 100",
)


# ---- scalar functions: a projection of named trees over one table


def project_query(name: str, of: str, key: str, nodes: dict, sqls: dict[str, str], digits: int | None = None) -> None:
    text = {k: f.to_json(n) for k, n in nodes.items()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
        return df.select(key, *(rounded(f.compile_filter(df, t)).alias(k) for k, t in text.items()))

    shown = {k: f"round({s}, {digits})" if digits is not None else s for k, s in sqls.items()}
    query(name, f"SELECT {key}, " + ", ".join(f"{s} AS {k}" for k, s in shown.items()) + f" FROM {of}")(run)


_K, _C, _B = f.var("o_orderkey", "int8"), f.var("o_custkey", "int8"), f.var("c_acctbal", "float8")
_three, _seven = f.const("int8", 3), f.const("int8", 7)
project_query(
    "arith_checked", "orders", "o_orderkey",
    {
        "a_add": f.call("kAddWithChecks", _K, _C, type="int8"),
        "a_sub": f.call("kSubtractWithChecks", _C, _K, type="int8"),
        "a_mul": f.call("kMultiplyWithChecks", _K, _C, type="int8"),
        "a_div": f.call("kDivideWithChecks", f.call("kSubtractWithChecks", _C, _K, type="int8"), _seven, type="int8"),
        "a_mod": f.call("kModuloWithChecks", f.call("kSubtractWithChecks", _C, _K, type="int8"), _three, type="int8"),
    },
    {
        "a_add": "o_orderkey + o_custkey", "a_sub": "o_custkey - o_orderkey", "a_mul": "o_orderkey * o_custkey",
        "a_div": "(o_custkey - o_orderkey) // 7", "a_mod": "(o_custkey - o_orderkey) % 3",
    },
)
_big = f.const("int8", 2**62)
project_query(
    "arith_unchecked", "orders", "o_orderkey",
    {
        "u_add": f.call("kAddWithoutChecks", f.call("kAddWithoutChecks", _K, _big, type="int8"), _big, type="int8"),
        "u_mul": f.call("kMultiplyWithoutChecks", _K, _big, type="int8"),
        "u_sub": f.call("kSubtractWithoutChecks", f.const("int8", -(2**63)), _K, type="int8"),
        "u_div": f.call("kDivideWithoutChecks", _K, _seven, type="int8"),
    },
    {
        "u_add": "((o_orderkey::HUGEINT + 9223372036854775808 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT",
        "u_mul": "((o_orderkey % 4) * 4611686018427387904::HUGEINT - CASE WHEN o_orderkey % 4 >= 2 THEN 18446744073709551616 ELSE 0 END)::BIGINT",
        "u_sub": "(CASE WHEN o_orderkey = 0 THEN -9223372036854775808 ELSE 9223372036854775808::HUGEINT - o_orderkey END)::BIGINT",
        "u_div": "o_orderkey // 7",
    },
)
project_query(
    "bitwise", "orders", "o_orderkey",
    {
        "b_and": f.call("kBitwiseAnd", _K, _C, type="int8"),
        "b_or": f.call("kBitwiseOr", _K, _C, type="int8"),
        "b_xor": f.call("kXor", _K, _C, type="int8"),
        "b_not": f.call("kBitwiseNot", _K, type="int8"),
    },
    {"b_and": "o_orderkey & o_custkey", "b_or": "o_orderkey | o_custkey", "b_xor": "xor(o_orderkey, o_custkey)", "b_not": "~o_orderkey"},
)
project_query(
    "math_sign_round", "customer", "c_custkey",
    {
        "m_abs": f.call("kAbsolute", _B, type="float8"),
        "m_neg": f.call("kNegative", _B, type="float8"),
        "m_sign": f.call("kSign", _B, type="float8"),
        "m_ceil": f.call("kCeil", _B, type="float8"),
        "m_floor": f.call("kFloor", _B, type="float8"),
        "m_round": f.call("kRound", _B, type="float8"),
    },
    {
        "m_abs": "abs(c_acctbal)", "m_neg": "-c_acctbal", "m_sign": "sign(c_acctbal)::DOUBLE",
        "m_ceil": "ceil(c_acctbal)", "m_floor": "floor(c_acctbal)", "m_round": "round_even(c_acctbal, 0)",
    },
    digits=6,
)
_D = f.var("l_discount", "float8")
project_query(
    "math_trig", "part", "p_partkey",
    {
        n: f.call(i, f.call("kDivideWithoutChecks", f.var("p_retailprice", "float8"), f.const("float8", 2500.0), type="float8"), type="float8")
        for n, i in [
            ("t_sin", "kSin"), ("t_cos", "kCos"), ("t_tan", "kTan"), ("t_cot", "kCot"), ("t_atan", "kAtan"),
            ("t_asin", "kAsin"), ("t_acos", "kAcos"), ("t_sinh", "kSinh"), ("t_cosh", "kCosh"), ("t_tanh", "kTanh"),
            ("t_sqrt", "kSqrt"), ("t_cbrt", "kCbrt"), ("t_exp", "kExp"), ("t_log", "kLog10"),
        ]
    },
    {
        f"t_{n}": f"{n if n != 'log' else 'log10'}(p_retailprice / 2500)"
        for n in ("sin", "cos", "tan", "cot", "atan", "asin", "acos", "sinh", "cosh", "tanh", "sqrt", "cbrt", "exp", "log")
    },
    digits=6,
)
project_query(
    "math_atan2", "part", "p_partkey",
    {"m_atan2": f.call("kAtan2", f.var("p_retailprice", "float8"), f.const("float8", 1000.0), type="float8")},
    {"m_atan2": "atan2(p_retailprice, 1000)"}, digits=6,
)
project_query(
    "casts", "orders", "o_orderkey",
    {
        "c_int4": f.call("kCastInt4", _C, type="int4"),
        "c_int8": f.call("kCastInt8", f.call("kCastInt4", _C, type="int4"), type="int8"),
        "c_float8": f.call("kCastFloat8", _C, type="float8"),
    },
    {"c_int4": "o_custkey::INTEGER", "c_int8": "o_custkey", "c_float8": "o_custkey::DOUBLE"},
)
_N, _T = f.var("p_name", "string"), f.var("p_type", "string")
project_query(
    "strings", "part", "p_partkey",
    {
        "s_len": f.call("kCharLength", _N, type="int4"),
        "s_lower": f.call("kLower", _T, type="string"),
        "s_upper": f.call("kUpper", _N, type="string"),
        "s_sub": f.call("kSubstring", _N, f.const("int8", 2), f.const("int8", 4), type="string"),
        "s_sub2": f.call("kSubstring", _N, f.const("int8", 3), type="string"),
        "s_locate": f.call("kLocate", _N, f.const("string", "a"), type="int4"),
        "s_concat": f.call("kConcatenate", _N, _T, type="string"),
        "s_ltrim": f.call("kLTrim", _N, f.const("string", "Pp"), type="string"),
        "s_rtrim": f.call("kRTrim", _N, f.const("string", "0123456789"), type="string"),
        "s_btrim": f.call("kBTrim", _N, f.const("string", "P0123456789"), type="string"),
    },
    {
        "s_len": "length(p_name)::INTEGER", "s_lower": "lower(p_type)", "s_upper": "upper(p_name)",
        "s_sub": "substring(p_name, 2, 4)", "s_sub2": "substring(p_name, 3)",
        "s_locate": "instr(p_name, 'a')::INTEGER", "s_concat": "p_name || p_type", "s_ltrim": "ltrim(p_name, 'Pp')",
        "s_rtrim": "rtrim(p_name, '0123456789')", "s_btrim": "trim(p_name, 'P0123456789')",
    },
)


# ---- calendar functions

_TS = f.var("ts", "timestamp")
_EXTRACT_SQL = {
    "millennium": "ceil(year(ts) / 1000)", "century": "ceil(year(ts) / 100)", "decade": "floor(year(ts) / 10)",
    "year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "week": "weekofyear(ts)", "day": "day(ts)",
    "hour": "hour(ts)", "minute": "minute(ts)", "second": "(epoch_us(ts) % 60000000) / 1000000",
    "milliseconds": "(epoch_us(ts) % 60000000) / 1000", "microseconds": "(epoch_us(ts) % 60000000)",
}
for _u in temporal.EXTRACT_UNITS:
    project_query(
        f"extract_{_u}", "events", "event_id",
        {"part": f.call("kExtractTimestamp", f.const("string", _u), _TS, type="float8")},
        {"part": f"({_EXTRACT_SQL[_u]})::DOUBLE"}, digits=6,
    )
_TRUNC_SQL = {
    u: f"date_trunc('{u}', ts)" for u in temporal.TRUNC_UNITS
} | {"millennium": "make_timestamp(((year(ts) - 1) // 1000) * 1000 + 1, 1, 1, 0, 0, 0)", "century": "make_timestamp(((year(ts) - 1) // 100) * 100 + 1, 1, 1, 0, 0, 0)"}


def _trunc_query(unit: str) -> None:
    text = f.to_json(f.call("kDateTrunc", f.const("string", unit), _TS, type="timestamp"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events")
        return df.select("event_id", F.unix_micros(f.compile_filter(df, text).cast("timestamp")).alias("start_us"))

    query(f"trunc_{unit}", f"SELECT event_id, epoch_us({_TRUNC_SQL[unit]}) AS start_us FROM events")(run)


for _u in temporal.TRUNC_UNITS:
    _trunc_query(_u)


@query("cast_timestamp", "SELECT event_id, epoch_us(ts) - 10800000000 AS wall_us, epoch_us(ts) + 10800000000 AS tz_us FROM events")
def cast_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts between timestamp and timestamptz by a fixed shift of three hours."""
    df = table(spark, sf_dir, "events")
    shift = 3 * 3_600_000_000
    tz = f.call("kCastTimestamptz", _TS, type="timestamptz")
    wall = f.call("kCastTimestamp", f.var("tz", "timestamptz"), type="timestamp")
    df = df.withColumn("tz", F.col("ts").cast("timestamp"))
    as_us = lambda node: F.unix_micros(f.compile_filter(df, f.to_json(node), shift).cast("timestamp"))
    return df.select("event_id", as_us(wall).alias("wall_us"), as_us(tz).alias("tz_us"))


@query("cast_date_diff", "SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS day, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders")
def cast_date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    day = f.call("kCastDate", ORDERED, type="date")
    diff = f.call("kDateDiff", day, f.const("date", 9131), type="int4")
    return df.select("o_orderkey", f.compile_filter(df, f.to_json(day)).cast("string").alias("day"), f.compile_filter(df, f.to_json(diff)).alias("days"))


@query("timestamp_plus_micros", "SELECT event_id, epoch_us(ts) + 1234567 AS later_us FROM events")
def timestamp_plus_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    node = f.call("kAddWithChecks", _TS, f.const("int8", 1_234_567), type="timestamp")
    return df.select("event_id", F.unix_micros(f.compile_filter(df, f.to_json(node)).cast("timestamp")).alias("later_us"))


# ---- scans and deletes


def lines_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select("*", F.col("_metadata.file_path").alias(deletes.FILE), F.col("_metadata.row_index").alias(deletes.POS))


def deleted_positions(lines: DataFrame, modulus: int, rest: int) -> DataFrame:
    return lines.where(F.col(deletes.POS) % modulus == rest).select(F.col(deletes.FILE).alias("file_path"), F.col(deletes.POS).alias("pos"))


_ROWS = "(SELECT *, row_number() OVER () - 1 AS pos FROM lineitem)"


def _three_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_linenumber").cast("bigint").alias("numbers")
    )


_SUMS = "count(*) AS n, sum(l_orderkey)::BIGINT AS keys, sum(l_linenumber)::BIGINT AS numbers"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter compiled from JSON, positional deletes, then equality deletes with a null key, and two columns."""
    lines = lines_with_position(spark, sf_dir)
    node = f.both(f.call("kGreaterThanOrEqualTo", SHIP, f.const("timestamp", 9131 * _DAY)), f.call("kLessThan", _D, f.const("float8", 0.05)))
    kept = lines.where(f.compile_filter(lines, f.to_json(node)))
    kept = deletes.positional(kept, deleted_positions(lines, 7, 3))
    gone = spark.range(1, 3).select(F.col("id").cast("int").alias("l_linenumber")).union(spark.range(1).select(F.lit(None).cast("int")))
    return deletes.equality(kept, gone, ["l_linenumber"]).select("l_orderkey", "l_linenumber")


query("flagship")(flagship)


@query("positional_deletes", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM {_ROWS} WHERE pos % 10 <> 3 GROUP BY ALL")
def positional_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_with_position(spark, sf_dir)
    return _three_sums(deletes.positional(lines, deleted_positions(lines, 10, 3)))


@query("positional_deletes_layers", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM {_ROWS} WHERE NOT (pos % 10 = 3 AND 1 + l_orderkey % 3 <= 2) GROUP BY ALL")
def positional_deletes_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of layer 2 hold for rows of layers 1 and 2, not 3."""
    lines = lines_with_position(spark, sf_dir).withColumn(deletes.SEQ, 1 + F.col("l_orderkey") % 3)
    return _three_sums(deletes.positional(lines, deleted_positions(lines, 10, 3).withColumn("seq", F.lit(2).cast("bigint"))))


@query("equality_deletes_1col", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY ALL")
def equality_deletes_1col(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return _three_sums(deletes.equality(table(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]))


@query("equality_deletes_2col", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_quantity < 10 AND d.l_partkey = l.l_partkey AND d.l_suppkey = l.l_suppkey) GROUP BY ALL")
def equality_deletes_2col(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return _three_sums(deletes.equality(lines, lines.where("l_quantity < 10"), ["l_partkey", "l_suppkey"]))


@query("equality_deletes_nulls", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END AS k FROM events) WHERE k IS NOT NULL AND k <> 5 GROUP BY ALL")
def equality_deletes_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key deletes the rows whose key is null."""
    events = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 10))
    gone = spark.range(5, 6).select(F.col("id").alias("k")).union(spark.range(1).select(F.lit(None).cast("bigint")))
    return deletes.equality(events, gone, ["k"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("equality_deletes_seq", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem WHERE NOT (l_linenumber <= 2 AND 1 + l_orderkey % 3 < 1 + l_linenumber) GROUP BY ALL")
def equality_deletes_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete holds for strictly older rows only; of a key that is deleted twice the newest delete counts."""
    lines = table(spark, sf_dir, "lineitem").withColumn(deletes.SEQ, 1 + F.col("l_orderkey") % 3)
    gone = spark.sql("SELECT * FROM VALUES (1, 2L), (1, 1L), (2, 3L) AS t(l_linenumber, seq)")
    return _three_sums(deletes.equality(lines, gone, ["l_linenumber"]))


@query("equality_deletes_global", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem WHERE l_linenumber <> 1 AND NOT (l_linenumber = 2 AND l_returnflag = 'A') GROUP BY ALL")
def equality_deletes_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpartitioned deletes hold in every partition, others in their own."""
    lines = table(spark, sf_dir, "lineitem").withColumn(deletes.PART, F.col("l_returnflag"))
    gone = spark.sql("SELECT * FROM VALUES (1, NULL), (2, 'A') AS t(l_linenumber, partition)")
    return _three_sums(deletes.equality(lines, gone, ["l_linenumber"]))


@query("equality_deletes_sets", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem WHERE l_linenumber <> 1 AND NOT (l_returnflag = 'A' AND l_linestatus = 'F') GROUP BY ALL")
def equality_deletes_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.sql("SELECT 1 AS l_linenumber")
    two = spark.sql("SELECT 'F' AS l_linestatus, 'A' AS l_returnflag")
    return _three_sums(deletes.equality_sets(table(spark, sf_dir, "lineitem"), [(["l_linenumber"], one), (["l_returnflag", "l_linestatus"], two)]))


@query("deletion_vector", f"SELECT l_returnflag, l_linestatus, {_SUMS} FROM {_ROWS} WHERE pos % 5 <> 2 GROUP BY ALL")
def deletion_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest vector of a file counts; an older one with other positions doesn't."""
    lines = lines_with_position(spark, sf_dir)
    vectors = lambda rest, seq: (
        deleted_positions(lines, 5, rest).groupBy("file_path").agg(F.collect_list("pos").alias("positions")).withColumn("seq", F.lit(seq).cast("bigint"))
    )
    return _three_sums(deletes.deletion_vectors(lines, vectors(2, 2).unionByName(vectors(4, 1))))


@query("project_rename", "SELECT n_name AS name, n_nationkey AS key FROM nation")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))


@query("default_fill", "SELECT n_nationkey, 'none' AS n_note FROM nation")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the files don't have, filled with its initial default by the scan."""
    from tidelake.sources.schema import with_defaults

    return with_defaults(table(spark, sf_dir, "nation"), {"n_note": ("string", "none")}).select("n_nationkey", "n_note")


@query("filter_late", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 20 AND l_shipdate < TIMESTAMP '1998-01-01'")
def filter_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    node = f.both(f.call("kGreaterThan", QTY, f.const("float8", 20.0)), f.call("kLessThan", SHIP, f.const("timestamp", 10227 * _DAY)))
    return df.where(f.compile_filter(df, f.to_json(node))).select("l_orderkey", "l_extendedprice")


@query("scan_prune_cols", "SELECT c_custkey, c_mktsegment FROM customer")
def scan_prune_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


@query("scan_row_index", "SELECT row_number() OVER () - 1 AS pos, n_nationkey FROM nation")
def scan_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("_metadata.row_index").alias("pos"), "n_nationkey")


@query("scan_multi_file", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def scan_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return nation.union(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


# ---- statistics

_NDV = ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"]


@query("ndv_exact", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS ndv FROM lineitem" for c in _NDV))
def ndv_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ndv_exact(table(spark, sf_dir, "lineitem"), _NDV)


@query("ndv_theta")
def ndv_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ndv_theta(table(spark, sf_dir, "lineitem"), _NDV)


@query("ndv_hll")
def ndv_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ndv_hll(table(spark, sf_dir, "lineitem"), _NDV)


@query("ndv_theta_union")
def ndv_theta_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches made for each ship mode apart and united."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("theta_sketch_agg(l_partkey)").alias("s"))
    return stats.union_theta(parts, "s").selectExpr("theta_sketch_estimate(s) AS ndv")


@query("quantile_bounds", "SELECT i, bound FROM (SELECT unnest(quantile_disc(l_linenumber, [0.0, 0.25, 0.5, 0.75, 1.0])) AS bound, unnest([0, 1, 2, 3, 4]) AS i FROM lineitem)")
def quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_bounds(table(spark, sf_dir, "lineitem"), "l_linenumber", 5)


@query(
    "quantile_bounds_strings",
    "WITH r AS (SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) AS rn, count(*) OVER () AS n FROM part WHERE p_brand IS NOT NULL),"
    " i AS (SELECT unnest([0, 1, 2, 3, 4]) AS i) SELECT i.i, r.v AS bound FROM i JOIN r ON r.rn = greatest(1, ceil(i.i * r.n / 4))",
)
def quantile_bounds_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_bounds(table(spark, sf_dir, "part"), "p_brand", 5)


@query("frequent_items", "SELECT l_suppkey AS item, count(*) AS \"count\" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent_items(table(spark, sf_dir, "lineitem"), "l_suppkey", 10)


@query("frequent_items_weighted", "SELECT l_suppkey AS item, sum(l_linenumber)::BIGINT AS \"count\" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def frequent_items_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent_items_weighted(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", 10)


@query("frequent_items_sketch", "SELECT l_linenumber AS item, count(*) AS \"count\" FROM lineitem GROUP BY 1")
def frequent_items_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent_items_sketch(table(spark, sf_dir, "lineitem"), "l_linenumber", 7)


@query("analyze_table")
def analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.analyze(table(spark, sf_dir, "lineitem"), exclude=["l_tax"])


@query(
    "order_totals",
    "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS status,"
    " round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) AS total_price FROM lineitem GROUP BY 1",
)
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.order_totals(table(spark, sf_dir, "lineitem")).withColumn("total_price", F.round("total_price", 2))


@query("size_percentiles", "SELECT unnest([50, 90, 99]) AS percent, unnest(quantile_disc(l_linenumber, [0.5, 0.9, 0.99])) AS value FROM lineitem")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_percentiles(table(spark, sf_dir, "lineitem"), "l_linenumber", [50, 90, 99])


# ---- partition transforms


def transform_query(name: str, of: str, key: str, column: str, transform: str, sql: str | None, text: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        out = transforms.apply(transform, F.col(column), df.schema[column].dataType)
        return df.select(key, (out.cast("string") if text else out).alias("p"))

    query(name, f"SELECT {key}, {sql} AS p FROM {of}" if sql else None)(run)


transform_query("tf_identity", "orders", "o_orderkey", "o_orderpriority", "identity", "o_orderpriority")
transform_query("tf_bucket", "orders", "o_orderkey", "o_custkey", "bucket[16]", None)
transform_query("tf_bucket_string", "customer", "c_custkey", "c_name", "bucket[16]", None)
transform_query("tf_truncate_string", "customer", "c_custkey", "c_name", "truncate[4]", "substring(c_name, 1, 4)")
transform_query("tf_truncate_long", "orders", "o_orderkey", "o_custkey", "truncate[100]", "o_custkey - (o_custkey % 100 + 100) % 100")
transform_query("tf_year", "orders", "o_orderkey", "o_orderdate", "year", "(year(o_orderdate) - 1970)::INTEGER")
transform_query("tf_month", "orders", "o_orderkey", "o_orderdate", "month", "((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INTEGER")
transform_query("tf_day", "orders", "o_orderkey", "o_orderdate", "day", "CAST(o_orderdate::DATE AS VARCHAR)", text=True)
transform_query("tf_hour", "events", "event_id", "ts", "hour", "floor(epoch_us(ts) / 3600000000)::INTEGER")
transform_query("tf_void", "orders", "o_orderkey", "o_orderdate", "void", "CAST(NULL AS INTEGER)")


# ---- snapshot tables: each query writes a table below the session's shared folder and reads it through its metadata

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _new_table(spark: SparkSession, rows: DataFrame, partitions: list[tuple[str, str]]) -> Table:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return Table.create(spark, f"{shared.rstrip('/')}/tables/{uuid.uuid4().hex}", rows.schema, partitions)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_ORDERS)


@query("table_append_read", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def table_append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, [("o_orderstatus", "identity")])
    t = t.append(rows.where("o_orderkey % 2 = 0")).append(rows.where("o_orderkey % 2 = 1"))
    return t.read(["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("table_filter_prunes", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-05-19'")
def table_filter_prunes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, [("o_orderstatus", "identity"), ("o_orderdate", "year")]).append(rows)
    node = f.both(
        f.call("kEqual", f.var("o_orderstatus", "string"), f.const("string", "F")), f.call("kLessThan", ORDERED, f.const("timestamp", 10000 * _DAY))
    )
    return t.read(["o_orderkey", "o_orderdate"], f.to_json(node))


@query("table_bucketed", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_custkey > 1200")
def table_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, [("o_custkey", "bucket[4]"), ("o_totalprice", "void")]).append(rows)
    customer = f.var("o_custkey", "int8")
    node = f.either(f.call("kEqual", customer, f.const("int8", 7)), f.call("kGreaterThan", customer, f.const("int8", 1200)))
    return t.read(["o_orderkey", "o_custkey"], f.to_json(node))


@query("table_time_travel", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def table_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, []).append(rows.where("o_orderkey % 3 = 0"))
    then = t.meta.snapshot()["snapshot-id"]
    t = t.append(rows.where("o_orderkey % 3 > 0")).delete_equal(rows.where("o_orderkey % 6 = 0").select("o_orderkey"))
    return t.read(["o_orderkey", "o_totalprice"], snapshot_id=then)


@query("table_positional_deletes", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def table_positional_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, [("o_orderstatus", "identity")]).append(rows)
    paths = [r.file_path for r in t.plan().collect()]
    at = spark.read.parquet(*paths).where("o_orderkey % 7 = 0").select(F.col("_metadata.file_path"), F.col("_metadata.row_index").alias("pos"))
    return t.delete_positions(at).read(["o_orderkey", "o_orderstatus"])


@query(
    "table_equality_deletes",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0",
)
def table_equality_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended after the deletes stay."""
    rows = _orders(spark, sf_dir)
    t = _new_table(spark, rows, [("o_orderstatus", "identity")]).append(rows)
    t = t.delete_equal(rows.where("o_orderkey % 5 = 0").select("o_orderkey")).append(rows.where("o_orderkey % 10 = 0"))
    return t.read(["o_orderkey", "o_orderstatus"])


@query("table_vector_deletes", "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) WHERE pos NOT IN (1, 3, 20)")
def table_vector_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer of two vectors of a file holds."""
    rows = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    t = _new_table(spark, rows, []).append(rows)
    path = t.plan().first().file_path
    return t.delete_vector(path, [0, 5]).delete_vector(path, [1, 3, 20]).read(["n_nationkey", "n_name"])


@query("table_plan_partitions", "SELECT count(DISTINCT o_orderstatus) AS partitions, count(*) AS records FROM orders")
def table_plan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    plan = _new_table(spark, rows, [("o_orderstatus", "identity")]).append(rows).plan()
    return planning.summary(plan).select("partitions").crossJoin(plan.agg(F.sum("record_count").alias("records")))
