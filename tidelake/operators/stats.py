"""Column statistics as mergeable aggregates: distinct counts, quantile bounds, frequent items, file summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HLL_LG_K = 11


def ndv_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: the number of distinct values that aren't null.

    Counted as (column, value) groups, so that no row is expanded for several distinct aggregates at once.
    """
    out = None
    for c in columns:
        one = df.select(F.col(c).alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*").alias("ndv"))
        one = one.select(F.lit(c).alias("column"), "ndv")
        out = one if out is None else out.union(one)
    return out


def _sketchable(df: DataFrame, c: str) -> str:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.IntegralType, T.StringType, T.BinaryType, T.DoubleType, T.FloatType)):
        return f"`{c}`"
    if isinstance(kind, T.DateType):
        return f"unix_date(`{c}`)"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"unix_micros(CAST(`{c}` AS TIMESTAMP))"
    return f"CAST(`{c}` AS STRING)"


def theta_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a theta sketch of each column."""
    return df.agg(*(F.expr(f"theta_sketch_agg({_sketchable(df, c)})").alias(c) for c in columns))


def ndv_theta(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = theta_sketches(df, columns)
    return s.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', theta_sketch_estimate(`{c}`)" for c in columns) + ") AS (column, ndv)")


def union_theta(sketches: DataFrame, column: str) -> DataFrame:
    """The union of sketches that were made apart, one a row."""
    return sketches.agg(F.expr(f"theta_union_agg(`{column}`)").alias(column))


def ndv_hll(df: DataFrame, columns: Sequence[str], lg_k: int = HLL_LG_K) -> DataFrame:
    parts = ", ".join(f"'{c}', hll_sketch_estimate(`{c}`)" for c in columns)
    s = df.agg(*(F.expr(f"hll_sketch_agg({_sketchable(df, c)}, {lg_k})").alias(c) for c in columns))
    return s.selectExpr(f"stack({len(columns)}, {parts}) AS (column, ndv)")


def quantile_bounds(df: DataFrame, column: str, n: int, accuracy: int = 10_000) -> DataFrame:
    """n bounds of equal depth at ranks i / (n - 1), as rows (i, bound); numbers by a mergeable sketch.

    Strings take exact ranks: the values' counts are summed in order inside ranges of values.
    """
    if n < 2:
        raise ValueError("bounds need n >= 2")
    if not isinstance(df.schema[column].dataType, T.StringType):
        shares = F.array(*(F.lit(i / (n - 1)) for i in range(n)))
        return df.agg(F.percentile_approx(column, shares, F.lit(accuracy)).alias("b")).select(F.posexplode("b").alias("i", "bound"))
    return string_bounds(df, column, n)


def string_bounds(df: DataFrame, column: str, n: int) -> DataFrame:
    """Exact bounds of strings: value ranges are ranked by their totals first, then only ranges that hold a bound."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("c").alias("total"))
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.sum("total").over(everything).alias("all"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.join(F.broadcast(base), "part").select("v", "all", (F.col("base") + F.sum("c").over(inside)).alias("upto"), "c")
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    wanted = F.filter(
        steps,
        lambda i: (F.ceil(i * F.col("all") / F.lit(n - 1)).between(F.col("upto") - F.col("c") + 1, F.col("upto")))
        | ((i == 0) & (F.col("upto") == F.col("c"))),
    )
    return ranks.select(F.explode(wanted).alias("i"), F.col("v").alias("bound"))


def frequent_items(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, exactly: (item, count), ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("item")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "item").limit(k)


def frequent_items_sketch(df: DataFrame, column: str, k: int, max_items: int = 10_000) -> DataFrame:
    """The same from a mergeable sketch of at most max_items counters: (item, count) estimates."""
    return df.agg(F.expr(f"approx_top_k(`{column}`, {k}, {max_items})").alias("t")).select(F.explode("t").alias("t")).select("t.item", "t.count")


def frequent_items_weighted(df: DataFrame, value: str, weight: str, k: int) -> DataFrame:
    """The k values of the largest summed weights."""
    return df.groupBy(F.col(value).alias("item")).agg(F.sum(weight).alias("count")).orderBy(F.desc("count"), "item").limit(k)


def analyze(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), bounds: int = 5, top: int = 5) -> DataFrame:
    """One row per column: rows, nulls, NDV estimates, bounds and frequent items as strings. One pass over the table."""
    names = [c for c in columns or df.columns if c not in exclude and not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        shares = F.array(*(F.lit(k / (bounds - 1)) for k in range(bounds)))
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"),
            F.expr(f"theta_sketch_agg({_sketchable(df, c)})").alias(f"theta_{i}"),
            (F.percentile_approx(c, shares).cast("array<string>") if numeric else F.lit(None).cast("array<string>")).alias(f"bounds_{i}"),
            F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {top}, 1000)").alias(f"top_{i}"),
        ]
    parts = ", ".join(f"'{c}', nulls_{i}, theta_sketch_estimate(theta_{i}), bounds_{i}, top_{i}" for i, c in enumerate(names))
    return df.agg(*aggs).selectExpr("rows", f"stack({len(names)}, {parts}) AS (column, nulls, ndv, bounds, top)").select("column", "rows", "nulls", "ndv", "bounds", "top")


def file_summary(files: DataFrame) -> DataFrame:
    """Counts and totals of files by content kind. files: content, record_count, file_size_in_bytes."""
    return files.groupBy("content").agg(F.count("*").alias("files"), F.sum("record_count").alias("records"), F.sum("file_size_in_bytes").alias("bytes"))


def order_totals(lines: DataFrame) -> DataFrame:
    """Per order: status (F if all lines are F, O if all are O, else P) and total price of its lines."""
    price = F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))
    return lines.groupBy("l_orderkey").agg(
        F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P").alias("status"),
        F.sum(price).alias("total_price"),
    )


def size_percentiles(files: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """Exact percentiles by rank of a column of file sizes: (percent, value)."""
    parts = ", ".join(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{column}`) AS p{p}" for p in percents)
    files.createOrReplaceTempView("_sizes")
    wide = files.sparkSession.sql(f"SELECT {parts} FROM _sizes")
    return wide.selectExpr(f"stack({len(percents)}, " + ", ".join(f"{p}, p{p}" for p in percents) + ") AS (percent, value)")
