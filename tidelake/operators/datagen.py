"""TPC-H-like data as plans over row ranges: every value is a function of its row number and a seed.

Tables are generated in parallel without state, so a lost task makes the same rows again. Deletes are split off by
masks: rows come with extra ones that equality or positional deletes remove again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base rows at scale factor 1.
ROWS = {"supplier": 10_000, "part": 200_000, "customer": 150_000, "orders": 1_500_000}
#: Word lists of the benchmark's text columns.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3),
    ("INDIA", 2), ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0),
    ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3),
    ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
]
COLORS = ["almond", "azure", "beige", "blue", "coral", "cream", "green", "ivory", "lime", "navy", "olive", "plum", "red", "rose", "tan", "white"]


def draw(seed: int, name: str, *keys: Column) -> Column:
    """A number below 2^62 that depends on the seed, a column's name and the row's keys."""
    return F.xxhash64(F.lit(seed), F.lit(name), *keys).bitwiseAND(F.lit((1 << 62) - 1))


def uniform(x: Column, low: int, high: int) -> Column:
    return x % (high - low + 1) + low


def bernoulli(x: Column, share: float) -> Column:
    return (x % 1_000_000) < int(share * 1_000_000)


def choice(x: Column, values: Sequence[str], weights: Sequence[int] | None = None) -> Column:
    """One of the values, with integer weights if given."""
    if weights is None:
        return F.get(F.array(*map(F.lit, values)), (x % len(values)).cast("int"))
    at, out, upto = x % sum(weights), None, 0
    for v, w in zip(values, weights, strict=True):
        upto += w
        out = F.when(at < upto, v) if out is None else out.when(at < upto, v)
    return out


def random_string(seed: int, name: str, key: Column, low: int, high: int, charset: str = "0123456789abcdefghijklmnopqrstuvwxyz, ") -> Column:
    """A string of low to high characters of the charset."""
    size = uniform(draw(seed, name + "/n", key), low, high).cast("int")
    one = lambda i: F.substr(F.lit(charset), (draw(seed, name, key, i) % len(charset) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), size), one), "")


def padded(prefix: str, key: Column, width: int = 9) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def money(x: Column, low: int, high: int) -> Column:
    return (uniform(x, low, high).cast("decimal(12,0)") / 100).cast("decimal(10,2)")


def phone(nation: Column, seed: int, key: Column) -> Column:
    part = lambda n, lo, hi: uniform(draw(seed, f"phone{n}", key), lo, hi).cast("string")
    return F.concat_ws("-", (nation + 10).cast("string"), part(1, 100, 999), part(2, 100, 999), part(3, 1000, 9999))


def sparse_key(i: Column) -> Column:
    """Order keys use 8 of every 32 numbers."""
    return F.shiftleft(F.floor(i / 8), 5) + i % 8


def retail_price(key: Column) -> Column:
    return ((90_000 + F.floor(key / 10) % 20_001 + 100 * (key % 1000)).cast("decimal(12,0)") / 100).cast("decimal(10,2)")


def supplier_of(part: Column, i: Column, suppliers: int) -> Column:
    """The i-th of a part's four suppliers."""
    return (part + i * (F.lit(suppliers // 4) + F.floor((part - 1) / suppliers))) % suppliers + 1


def customer_key(x: Column, customers: int) -> Column:
    """Customers whose key divides by three place no orders."""
    pick = x % (customers // 3 * 2)
    return F.floor(pick / 2) * 3 + pick % 2 + 1


def region(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REGIONS)), "r_regionkey int, r_name string")


def nation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(NATIONS)], "n_nationkey int, n_name string, n_regionkey int")


def _rows(spark: SparkSession, table: str, scale: float) -> DataFrame:
    return spark.range(1, max(1, int(ROWS[table] * scale)) + 1).withColumnRenamed("id", "k")


def supplier(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    k, home = F.col("k"), uniform(draw(seed, "s_nation", F.col("k")), 0, 24).cast("int")
    return _rows(spark, "supplier", scale).select(
        k.alias("s_suppkey"), padded("Supplier#", k).alias("s_name"), random_string(seed, "s_address", k, 10, 40).alias("s_address"),
        home.alias("s_nationkey"), phone(home, seed, k).alias("s_phone"), money(draw(seed, "s_acctbal", k), -99_999, 999_999).alias("s_acctbal"),
        # five in ten thousand comments tell of complaints, five of recommendations
        choice(draw(seed, "s_comment", k), ["Customer Complaints", "Customer Recommends", "quiet deliveries"], [5, 5, 9990]).alias("s_comment"),
    )


def part(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    k = F.col("k")
    m = uniform(draw(seed, "p_mfgr", k), 1, 5)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: choice(draw(seed, "p_name", k, i), COLORS)), " ")
    return _rows(spark, "part", scale).select(
        k.alias("p_partkey"), words.alias("p_name"), F.concat(F.lit("Manufacturer#"), m.cast("string")).alias("p_mfgr"),
        F.concat(F.lit("Brand#"), m.cast("string"), uniform(draw(seed, "p_brand", k), 1, 5).cast("string")).alias("p_brand"),
        uniform(draw(seed, "p_size", k), 1, 50).cast("int").alias("p_size"), retail_price(k).alias("p_retailprice"),
    )


def partsupp(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    suppliers = max(4, int(ROWS["supplier"] * scale))
    p, i = F.col("k"), F.col("i")
    rows = _rows(spark, "part", scale).select("k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return rows.select(
        p.alias("ps_partkey"), supplier_of(p, i, suppliers).alias("ps_suppkey"), uniform(draw(seed, "ps_qty", p, i), 1, 9999).cast("int").alias("ps_availqty"),
        money(draw(seed, "ps_cost", p, i), 100, 100_000).alias("ps_supplycost"),
    )


def customer(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    k, home = F.col("k"), uniform(draw(seed, "c_nation", F.col("k")), 0, 24).cast("int")
    return _rows(spark, "customer", scale).select(
        k.alias("c_custkey"), padded("Customer#", k).alias("c_name"), home.alias("c_nationkey"), phone(home, seed, k).alias("c_phone"),
        money(draw(seed, "c_acctbal", k), -99_999, 999_999).alias("c_acctbal"), choice(draw(seed, "c_segment", k), SEGMENTS).alias("c_mktsegment"),
    )


def lineitem(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    """One to seven lines of each order; the line number is the position within the order."""
    parts, suppliers = max(1, int(ROWS["part"] * scale)), max(4, int(ROWS["supplier"] * scale))
    k, n = F.col("k"), F.col("n")
    ordered = F.date_add(F.lit("1992-01-01").cast("date"), uniform(draw(seed, "o_date", k), 0, 2405).cast("int"))
    rows = _rows(spark, "orders", scale).select(
        "k", ordered.alias("od"), F.explode(F.sequence(F.lit(1), uniform(draw(seed, "o_lines", k), 1, 7).cast("int"))).alias("n")
    )
    rows = rows.withColumns(
        {
            "p": uniform(draw(seed, "l_part", k, n), 1, parts), "q": uniform(draw(seed, "l_qty", k, n), 1, 50),
            "ship": F.date_add("od", uniform(draw(seed, "l_ship", k, n), 1, 121).cast("int")),
        }
    )
    rows = rows.withColumn("receipt", F.date_add("ship", uniform(draw(seed, "l_receipt", k, n), 1, 30).cast("int")))
    now = F.lit("1995-06-17").cast("date")
    return rows.select(
        sparse_key(k).alias("l_orderkey"), F.col("p").alias("l_partkey"), supplier_of(F.col("p"), uniform(draw(seed, "l_supp", k, n), 0, 3), suppliers).alias("l_suppkey"),
        n.cast("int").alias("l_linenumber"), F.col("q").cast("decimal(10,2)").alias("l_quantity"), (F.col("q").cast("int") * retail_price(F.col("p"))).cast("decimal(12,2)").alias("l_extendedprice"),
        (uniform(draw(seed, "l_disc", k, n), 0, 10).cast("decimal(4,0)") / 100).cast("decimal(10,2)").alias("l_discount"),
        (uniform(draw(seed, "l_tax", k, n), 0, 8).cast("decimal(4,0)") / 100).cast("decimal(10,2)").alias("l_tax"),
        F.when(F.col("receipt") <= now, choice(draw(seed, "l_flag", k, n), ["R", "A"])).otherwise("N").alias("l_returnflag"),
        F.when(F.col("ship") > now, "O").otherwise("F").alias("l_linestatus"), F.col("ship").alias("l_shipdate"), choice(draw(seed, "l_mode", k, n), MODES).alias("l_shipmode"),
    )


def orders(spark: SparkSession, scale: float, seed: int = 0) -> DataFrame:
    """Orders with status and total price from their lines."""
    from tidelake.operators.stats import order_totals

    k = F.col("k")
    heads = _rows(spark, "orders", scale).select(
        sparse_key(k).alias("o_orderkey"), customer_key(draw(seed, "o_cust", k), max(3, int(ROWS["customer"] * scale))).alias("o_custkey"),
        F.date_add(F.lit("1992-01-01").cast("date"), uniform(draw(seed, "o_date", k), 0, 2405).cast("int")).alias("o_orderdate"),
        choice(draw(seed, "o_priority", k), PRIORITIES).alias("o_orderpriority"),
    )
    totals = order_totals(lineitem(spark, scale, seed))
    return heads.join(totals, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").withColumnRenamed("status", "o_orderstatus").withColumnRenamed("total_price", "o_totalprice")


TABLES = {"supplier": supplier, "part": part, "partsupp": partsupp, "customer": customer, "orders": orders, "lineitem": lineitem}


def equality_split(rows: DataFrame, mask: Column, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(survivors, deletes): rows under the mask become deletes of their keys; no survivor has such keys."""
    gone = rows.where(mask).select(*keys).distinct()
    on = None
    named = gone.select(*(F.col(c).alias(f"d_{c}") for c in keys))
    for c in keys:
        same = F.col(c).eqNullSafe(F.col(f"d_{c}"))
        on = same if on is None else on & same
    return rows.join(named, on, "left_anti"), gone


def positional_split(written: DataFrame, mask: Column) -> DataFrame:
    """(file_path, pos) of the rows of written files that the mask deletes."""
    rows = written.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    return rows.where(mask).select("file_path", "pos")


def generate(spark: SparkSession, folder: str, scale: float, seed: int = 0, files: int = 4, codec: str = "zstd", fmt: str = "parquet") -> None:
    """All tables below a folder, each in ``files`` files; codec none, snappy, lz4 or zstd; parquet or csv."""
    for name, make in {**TABLES, "region": lambda s, *_: region(s), "nation": lambda s, *_: nation(s)}.items():
        writer = make(spark, scale, seed).repartition(1 if name in ("region", "nation") else files).write.mode("errorifexists")
        if fmt == "csv":
            writer.option("header", True).csv(f"{folder}/{name}.csv")
        else:
            writer.option("compression", codec).parquet(f"{folder}/{name}.parquet")
