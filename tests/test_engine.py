"""Every query with an oracle against DuckDB, and codecs, tables, deletes and tools against plain versions."""

import json
import os
import random
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import queries as engine
from tidelake.functions import transforms
from tidelake.operators import datagen, deletes, stats
from tidelake.plans import filters as f
from tidelake.plans import planning, tools
from tidelake.plans.interval import Bounds, Match, evaluate
from tidelake.sources import avro, files, manifests, puffin, roaring
from tidelake.sources import schema as S
from tidelake.sources.catalog import FolderCatalog, NessieCatalog, RestCatalog
from tidelake.sources.metadata import MetadataError, TableMetadata, spark_type
from tidelake.sources.table import CommitError, Table
from tidelake.streaming.ingest import append_stream


def canonical(frame):
    cols = sorted(frame.columns)
    as_text = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float, Decimal, np.number)) else str(v)
    return cols, sorted(tuple(map(as_text, r)) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, duck, name):
    got = engine.QUERIES[name](spark, sf).toPandas()
    if name in engine.ORACLES:
        assert canonical(got) == canonical(duck.execute(engine.ORACLES[name]).fetchdf())
    else:
        assert len(got)


# ---- filters


def test_filter_json_round_trip():
    node = f.If(
        f.both(f.call("kLessThan", f.var("a", "int4"), f.const("int4", 1)), f.no(f.call("kIsNull", f.var("b", "string")))),
        f.over("kEqual", f.var("c", "numeric"), "numeric", ["0", None, "4.2"]),
        f.call("kLike", f.var("b", "string"), f.const("string", "a%")),
    )
    assert f.from_json(f.to_json(node)) == node and f.columns(node) == {"a", "b", "c"}
    assert f.to_json(f.var("col1", "bool")) == '{"node-type":"var","val-type":"bool","col-name":"col1"}'
    assert f.from_json("") is None and f.to_json(None) == ""


@pytest.mark.parametrize("text", ["{", "[]", '{"node-type":"x"}', '{"node-type":"const","value":{"val-type":"int4","value":"1"}}', '{"node-type":"logical","logic-op":"kNot","args":[]}', '{"node-type":"var","val-type":"int3","col-name":"a"}'])
def test_bad_filters(text):
    with pytest.raises(f.FilterError):
        f.from_json(text)


def test_filter_rules(spark):
    df = spark.createDataFrame([(1, "a_b")], "a int, s string")
    with pytest.raises(ValueError):
        f.compile_filter(df, f.call("kLike", f.var("s", "string"), f.const("string", "a\\_b")))
    with pytest.raises(ValueError):
        f.compile_filter(df, f.call("kExtractTimestamp", f.const("string", "dow"), f.const("timestamp", 0), type="float8"))
    with pytest.raises(f.FilterError):
        f.compile_filter(df, f.If(f.const("bool", True), f.const("int4", 1), f.const("int8", 1)))
    over = f.call("kAddWithChecks", f.var("a", "int4"), f.const("int4", 2**31 - 1), type="int4")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        df.select(f.compile_filter(df, over)).collect()


def test_interval_evaluation_is_sound():
    """NONE and ALL must hold for every row that the bounds allow."""
    rng = random.Random(5)
    ops = list(f.COMPARISONS)

    def tree(depth):
        if depth and rng.random() < 0.6:
            op = rng.choice(["kAnd", "kOr", "kNot"])
            return f.Logical(op, tuple(tree(depth - 1) for _ in range(1 if op == "kNot" else 2)))
        a = f.var(rng.choice("ab"), "int4")
        if rng.random() < 0.2:
            return f.call("kIsNull", a)
        if rng.random() < 0.2:
            return f.over(rng.choice(ops), a, "int4", [rng.randrange(6), rng.randrange(6)], rng.random() < 0.5)
        return f.call(rng.choice(ops), a, rng.choice([f.const("int4", rng.randrange(6)), f.var("b", "int4")]))

    compare = {"kLessThan": lambda x, y: x < y, "kLessThanOrEqualTo": lambda x, y: x <= y, "kGreaterThan": lambda x, y: x > y, "kGreaterThanOrEqualTo": lambda x, y: x >= y, "kEqual": lambda x, y: x == y, "kNotEqual": lambda x, y: x != y}

    def value(n, row):
        if isinstance(n, f.Variable):
            return row[n.name]
        if isinstance(n, f.Const):
            return n.value
        if isinstance(n, f.Logical):
            v = [value(a, row) for a in n.args]
            if n.op == "kNot":
                return None if v[0] is None else not v[0]
            wins = n.op == "kOr"
            return wins if wins in v else None if None in v else not wins
        if isinstance(n, f.ArrayFunction):
            v = [None if value(n.lhs, row) is None else compare[n.id](value(n.lhs, row), x) for x in n.array]
            return n.use_or if n.use_or in v else None if None in v else not n.use_or
        if n.id == "kIsNull":
            return value(n.args[0], row) is None
        x, y = (value(a, row) for a in n.args)
        return None if x is None or y is None else compare[n.id](x, y)

    for _ in range(400):
        rows = [{c: rng.choice([None, *range(6)]) if rng.random() < 0.3 else rng.randrange(6) for c in "ab"} for _ in range(rng.randint(1, 3))]
        bounds = {}
        for c in "ab":
            known = [r[c] for r in rows if r[c] is not None]
            bounds[c] = Bounds(min(known, default=None), max(known, default=None), len(known) < len(rows), not known)
        node = tree(2)
        passed, m = [value(node, r) is True for r in rows], evaluate(node, bounds)
        assert not (m is Match.NONE and any(passed)) and not (m is Match.ALL and not all(passed)), (node, rows)


# ---- deletes, against loops


def test_deletes_against_loops(spark):
    rng = random.Random(2)
    rows = [(f"/f{rng.randrange(3)}", i, rng.randrange(1, 4), rng.choice(["p", "q"]), rng.choice([None, 1, 2, 3])) for i in range(200)]
    data = spark.createDataFrame(rows, "_file string, _pos long, _seq long, _partition string, k int")
    pos = [(f"file:/f{rng.randrange(3)}", rng.randrange(200), rng.randrange(1, 4), rng.choice(["p", "q"])) for _ in range(300)]
    got = {r._pos for r in deletes.positional(data, spark.createDataFrame(pos, "file_path string, pos long, seq long, partition string")).collect()}
    assert got == {r[1] for r in rows if not any(p[0][5:] == r[0] and p[1] == r[1] and p[2] >= r[2] and p[3] == r[3] for p in pos)}
    eq = [(rng.choice([None, 1, 2]), rng.randrange(1, 5), rng.choice([None, "p", "q"])) for _ in range(4)]
    got = {r._pos for r in deletes.equality(data, spark.createDataFrame(eq, "k int, seq long, partition string"), ["k"]).collect()}
    assert got == {r[1] for r in rows if not any(e[0] == r[4] and e[1] > r[2] and e[2] in (None, r[3]) for e in eq)}
    dv = [("/f0", 2, list(range(0, 200, 2))), ("/f0", 1, list(range(200))), ("/f1", 3, [])]
    got = {r._pos for r in deletes.deletion_vectors(data, spark.createDataFrame(dv, "file_path string, seq long, positions array<long>")).collect()}
    assert got == {r[1] for r in rows if not (r[0] == "/f0" and r[2] <= 2 and r[1] % 2 == 0)}
    with pytest.raises(deletes.DeleteError):
        deletes.check_positional_schema(T.StructType([T.StructField("a", T.IntegerType())]))


# ---- codecs


def test_avro_round_trip():
    schema = {
        "type": "record", "name": "r",
        "fields": [
            {"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "array", "items": "string"}}, {"name": "c", "type": {"type": "map", "values": "double"}},
            {"name": "d", "type": {"type": "fixed", "name": "four", "size": 4}}, {"name": "e", "type": {"type": "enum", "name": "en", "symbols": ["x", "y"]}}, {"name": "f", "type": "boolean"},
            {"name": "g", "type": ["null", "four"]}, {"name": "h", "type": "float"},
        ],
    }
    rows = [{"a": v, "b": ["é", ""], "c": {"k": 0.5}, "d": b"1234", "e": "y", "f": True, "g": None, "h": 1.5} for v in (None, 0, -1, 2**62, -(2**63))]
    for codec in ("null", "deflate"):
        meta, got_schema, got = avro.read(avro.write(schema, rows, {"m": "v"}, codec, per_block=2))
        assert list(got) == rows and meta["m"] == b"v" and got_schema == schema
    with pytest.raises(avro.AvroError):
        avro.read(b"nope")
    data = avro.write(schema, rows)
    with pytest.raises(avro.AvroError):
        list(avro.read(data[:-20])[2])


def test_roaring_round_trip(spark):
    rng = random.Random(1)
    cases = [[], [0], list(range(100_000)), rng.sample(range(1 << 20), 50_000), [5, 1 << 33, (1 << 40) + 7], rng.sample(range(1 << 34), 500)]
    jvm = spark._jvm
    for values in cases:
        blob = roaring.vector_blob(values)
        assert roaring.read_vector_blob(blob).tolist() == sorted(values)
    bitmap = jvm.org.roaringbitmap.RoaringBitmap()
    bitmap.deserialize(jvm.java.nio.ByteBuffer.wrap(roaring.encode(cases[3])[12:]))
    assert bitmap.getCardinality() == 50_000 and bitmap.contains(cases[3][0])
    broken = bytearray(roaring.vector_blob([1, 2, 3]))
    broken[-1] ^= 1
    with pytest.raises(roaring.BitmapError):
        roaring.read_vector_blob(bytes(broken))


def test_puffin_round_trip():
    b = puffin.Builder()
    first, second = b.add(b"one", "t1", [1], 5, 6, ndv="3"), b.add(b"", "t2", [2, 3])
    data = b.build({"created-by": "x"})
    blobs, properties = puffin.footer(data)
    assert blobs == [first, second] and properties == {"created-by": "x"} and puffin.blob_bytes(data, blobs[0]) == b"one"
    for bad in (b"", data[:-1], b"XXXX" + data[4:]):
        with pytest.raises(puffin.PuffinError):
            puffin.footer(bad)


def test_bounds_round_trip():
    cases = [("int", -5), ("long", 2**40), ("string", "é"), ("boolean", True), ("double", 1.5), ("date", 7), ("timestamp", -1), ("decimal(9, 2)", Decimal("-3.25")), ("decimal(9, 2)", Decimal("0.00")), ("binary", b"ab")]
    for kind, v in cases:
        assert manifests.bound_value(kind, manifests.bound_bytes(kind, v)) == v
    assert manifests.bound_value("long", manifests.bound_bytes("int", 3)) == 3 and manifests.bound_value("int", None) is None


# ---- transforms


def test_transforms(spark):
    one = spark.range(1)
    assert one.select(transforms.murmur3_long(F.lit(87654321)), transforms.bucket(F.lit(87654321), 12345678, T.LongType())).first()[:] == (1871343545, 7146167)
    assert [one.select(transforms.murmur3_bytes(F.lit(s).cast("binary"))).first()[0] for s in ("hello", "hello, world", "")] == [613153351, 345750399, 0]
    assert [one.select(transforms.truncate(F.lit(v), 10, T.IntegerType())).first()[0] for v in (1, -1, 10)] == [0, -10, 10]
    assert one.select(transforms.truncate(F.lit(Decimal("10.65")), 50, T.DecimalType(9, 2))).first()[0] == Decimal("10.50")
    ts = F.lit("1969-12-31 23:30:00").cast("timestamp_ntz")
    got = one.select(*(transforms.apply(t, ts, T.TimestampNTZType()).cast("string") for t in ("year", "month", "day", "hour"))).first()
    assert tuple(got) == ("-1", "-1", "1969-12-31", "-1")
    with pytest.raises(ValueError):
        transforms.apply("bucket[0]", F.lit(1), T.LongType())


# ---- metadata, tables, planning


def test_metadata(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/m", T.StructType([T.StructField("a", T.LongType()), T.StructField("d", T.DecimalType(9, 2))]))
    again = TableMetadata.from_json(t.meta.to_json(pretty=True))
    assert again.raw == t.meta.raw and again.find_field("A", ignore_case=True)["id"] == 1 and again.find_field("A") is None
    for broken in ("{", "[]", "{}", json.dumps(t.meta.raw | {"current-schema-id": 9}), json.dumps(t.meta.raw | {"current-snapshot-id": 9}), json.dumps(t.meta.raw | {"refs": {"b": {"snapshot-id": 1, "type": "tag"}}})):
        with pytest.raises(MetadataError):
            TableMetadata.from_json(broken)
    assert spark_type("decimal(2,-5)") == T.DecimalType(7, 0) and spark_type({"type": "list", "element": {"type": "list", "element": "int"}}).simpleString() == "array<array<int>>"
    moved = t.meta.relocated(f"{tmp_path}/m", "s3://b/m")
    assert moved.location == "s3://b/m"
    order = [{"transform": "identity", "source-id": 1, "direction": "asc", "null-order": "nulls-first"}]
    sorted_once = t.meta.with_sort_order(order)
    assert sorted_once.raw["default-sort-order-id"] == 1 == sorted_once.with_sort_order(order).raw["default-sort-order-id"]
    assert tools.validate_metadata(t.meta, {"partitioned": True, "sorted": True, "forbidden_types": ["decimal"], "required_properties": {"x": "1"}}) == ["partitioned", "sorted", "property x", "type of d"]
    late = TableMetadata(t.meta.raw | {"snapshot-log": [{"timestamp-ms": 100_000_000}, {"timestamp-ms": 0}]})
    with pytest.raises(MetadataError):
        late.check_order()


def frame(spark, n=100):
    return spark.range(n).select(F.col("id").alias("a"), (F.col("id") % 5).cast("int").alias("b"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("c"))


def test_partitioned_table(spark, tmp_path):
    df = frame(spark)
    t0 = FolderCatalog(spark, str(tmp_path)).create_table("db", "one", df.schema, [("b", "identity")])
    t1 = t0.append(df)
    t2 = t1.append(frame(spark, 10))
    t3 = t2.delete_equal(spark.sql("SELECT 7L AS a"))
    assert (t1.read().count(), t2.read().count(), t3.read().count()) == (100, 110, 108)
    assert t3.read(snapshot_id=t1.meta.snapshot()["snapshot-id"]).count() == 100
    node = f.both(f.call("kGreaterThan", f.var("b", "int4"), f.const("int4", 2)), f.call("kLessThan", f.var("a", "int8"), f.const("int8", 50)))
    assert {r.a for r in t1.read(["a"], f.to_json(node)).collect()} == {i for i in range(50) if i % 5 > 2}
    assert t1.plan(node).where("content = 0").count() == 2
    assert t1.plan(f.call("kGreaterThan", f.var("a", "int8"), f.const("int8", 1000))).count() == 0
    assert planning.same_plan(t1.plan(), t1.plan()) and not planning.same_plan(t1.plan(), t2.plan())
    t4 = t3.append(spark.sql("SELECT 7L AS a, 2 AS b, 'new' AS c"))
    assert t4.read().where("a = 7").count() == 1  # newer rows aren't deleted
    with pytest.raises(CommitError):
        t3.append(df)
    assert FolderCatalog(spark, str(tmp_path)).tables() == [("db", "one")]
    where = t4.metadata_location
    assert RestCatalog(spark, "http://h", "w", lambda u: {"metadata-location": where}).load_table("db", "one").read().count() == 109
    assert NessieCatalog(spark, "http://h", fetch=lambda u: {"content": {"metadataLocation": where}}).location("db", "one") == where
    assert tools.snapshots(t4).count() == 4 and tools.manifest_list(t4).count() == 4
    assert tools.describe(t4, postgres=True)[2][:2] == ("c", "text")
    assert tools.validate_files(t4, {"max_delete_files": 0, "max_data_files": 99}) and not tools.validate_files(t4, {"max_data_files": 99})


@pytest.mark.parametrize("spec", [[], [("b", "identity"), ("c", "truncate[2]")]])
def test_entries_are_counted_without_a_sort(spark, tmp_path, monkeypatch, spec):
    """Bounds of strings need no sort of all rows: a task's memory then grows with its files, not with their rows."""
    plans, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    rows = frame(spark).union(spark.sql("SELECT NULL AS a, 4 AS b, NULL AS c"))
    t = Table.create(spark, f"{tmp_path}/e", rows.schema, spec).append(rows)
    assert plans and all("SortAggregate" not in p and "ObjectHashAggregate" in p for p in plans)
    monkeypatch.undo()
    sizes = dict(files.listed(spark, f"{tmp_path}/e/data"))
    entries = [r["data_file"] for m in manifests.read_list(files.read_bytes(spark, t.meta.snapshot()["manifest-list"])) for r in manifests.read_manifest(files.read_bytes(spark, m["manifest_path"]))]
    assert min(dict(e["lower_bounds"])[3] for e in entries if 3 in dict(e["lower_bounds"])) == b"x0"
    assert sum(e["record_count"] for e in entries) == 101 and {e["file_size_in_bytes"] for e in entries} <= set(sizes.values())


def test_positional_deletes_of_a_partitioned_table(spark, tmp_path):
    rows = spark.sql("SELECT id AS a, CAST(id % 5 AS INT) AS b, CAST(id % 3 AS DECIMAL(5, 2)) AS d, CAST(id % 2 AS STRING) AS x FROM range(100)")
    t = Table.create(spark, f"{tmp_path}/p", rows.schema, [("b", "identity"), ("d", "identity"), ("x", "identity")]).append(rows)
    at = spark.read.parquet(*[r.file_path for r in t.plan().collect()]).where("a IN (3, 8, 55)").select(F.col("_metadata.file_path"), F.col("_metadata.row_index").alias("pos"))
    u = t.delete_positions(at.union(spark.sql("SELECT '/elsewhere' AS file_path, 1L AS pos")))
    assert {r.a for r in u.read(["a"]).collect()} == set(range(100)) - {3, 8, 55}
    v = u.append(rows.where("a = 3"))
    assert {r.a for r in v.read(["a"]).collect()} == set(range(100)) - {8, 55}
    assert v.delete_positions(at.where("false")).read().count() == 98


def test_joins_of_deletes_carry_no_names(spark, tmp_path, monkeypatch):
    """Rows meet deletes by the numbers of their files and partitions, on both sides; paths of files stay out of the joins."""
    seen, kinds = [], {name: getattr(deletes, name) for name in ("positional", "deletion_vectors", "equality_sets")}
    for name, of in kinds.items():
        monkeypatch.setattr(deletes, name, lambda df, gone, of=of: seen.append((df, gone)) or of(df, gone))
    rows = frame(spark)
    t = Table.create(spark, f"{tmp_path}/n", rows.schema, [("c", "truncate[2]"), ("b", "identity")]).append(rows)
    u = t.delete_positions(spark.read.parquet(*[r.file_path for r in t.plan().collect()]).where("a IN (3, 8)").select(F.col("_metadata.file_path"), F.col("_metadata.row_index").alias("pos")))
    w = Table.create(spark, f"{tmp_path}/v", rows.schema).append(rows.coalesce(1))
    assert {r.a for r in u.delete_equal(spark.sql("SELECT 7L AS a")).append(rows.where("a = 8")).read(["a"]).collect()} == set(range(100)) - {3, 7}
    assert w.delete_vector(w.plan().first().file_path, [1, 2]).read(["a"]).count() == 98
    sides = [x for df, gone in seen for x in (df, *([f for _, f in gone] if isinstance(gone, list) else [gone]))]
    assert len(sides) == 6
    for side in sides:
        for c in {"_file", "_partition", "file_path", "partition"} & set(side.columns):
            assert side.select(F.max(F.length(c))).first()[0] in (None, 1, 2), c


def test_positional_and_vector_deletes(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/two", frame(spark).schema).append(frame(spark).coalesce(1))
    path = t.plan().first().file_path
    gone = spark.createDataFrame([(path, 0), (path, 2), (path, 2), ("/elsewhere", 1)], "file_path string, pos long")
    u = t.delete_positions(gone)
    assert u.read().count() == 98 and u.metrics(u.plan())["positional_deletes"] >= 1
    v = t.__class__.create(spark, f"{tmp_path}/three", frame(spark).schema).append(frame(spark).coalesce(1))
    path = v.plan().first().file_path
    w = v.delete_vector(path, [1, 5, 9]).delete_vector(path, [1, 5, 9, 11])
    assert w.read().count() == 96 and w.read(snapshot_id=v.meta.snapshot()["snapshot-id"]).count() == 100
    x = w.delete_positions(spark.createDataFrame([(path, 3)], "file_path string, pos long"))
    with pytest.raises(Exception, match="deletion vector and other deletes"):
        x.read().count()


def test_defaults_and_names(spark, tmp_path):
    spark.sql("SELECT 1L AS a, 'x' AS old").coalesce(1).write.parquet(f"{tmp_path}/p")
    schema = T.StructType([S.field("a", T.LongType(), 1), S.field("renamed", T.StringType(), 2), S.field("extra", T.IntegerType(), 3, default_sql="CAST(7 AS INT)")])
    mapping = S.name_mapping('[{"field-id":1,"names":["a"]},{"field-id":2,"names":["old"]}]')
    assert S.read_by_name_mapping(spark, schema, mapping, [f"{tmp_path}/p"]).first()[:] == (1, "x", 7)
    by_id = T.StructType([T.StructField("a", T.LongType(), True, {S.FIELD_ID: 1}), T.StructField("old", T.StringType(), True, {S.FIELD_ID: 2})])
    spark.createDataFrame([(1, "x")], by_id).coalesce(1).write.parquet(f"{tmp_path}/q")
    assert S.read_by_id(spark, schema, [f"{tmp_path}/q"]).first()[:] == (1, "x", 7)


def test_segments(spark):
    rows = [("p", 4, 10), ("p", 14, 6), ("p", 30, 5), ("p", 32, 0), ("q", 4, 0)]
    got = {tuple(r) for r in planning.merged_segments(spark.createDataFrame(rows, "path string, offset long, length long")).collect()}
    assert got == {("p", 4, 16), ("p", 30, 0), ("q", 4, 0)}


def test_statistics_file(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/s", frame(spark).schema).append(frame(spark))
    u = tools.store_statistics(t, ["a", "b"])
    blobs = tools.puffin_blobs(u, u.meta.raw["statistics"][0]["statistics-path"])
    assert [(b.fields, b.properties["ndv"]) for b in blobs] == [([1], "100"), ([2], "5")]
    assert stats.frequent_items(frame(spark), "b", 2).count() == 2


def test_generator(spark, tmp_path):
    a, b = datagen.lineitem(spark, 0.001, 3), datagen.lineitem(spark, 0.001, 3)
    assert a.exceptAll(b).isEmpty() and not a.exceptAll(datagen.lineitem(spark, 0.001, 4)).isEmpty()
    assert a.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"), F.count("*").alias("n")).where("m <> n OR n > 7").isEmpty()
    orders = datagen.orders(spark, 0.001, 3)
    assert orders.count() == 1500 and orders.where("o_custkey % 3 = 0").isEmpty()
    assert datagen.partsupp(spark, 0.01).groupBy("ps_partkey").agg(F.count_distinct("ps_suppkey").alias("n")).where("n <> 4").isEmpty()
    rows, gone = datagen.equality_split(a, F.col("l_linenumber") == 7, ["l_orderkey", "l_linenumber"])
    assert rows.count() + gone.count() == a.count()
    datagen.generate(spark, f"{tmp_path}/gen", 0.0005, files=2)
    back = spark.read.parquet(f"{tmp_path}/gen/lineitem.parquet")
    pos = datagen.positional_split(back, F.col("l_linenumber") == 1)
    assert pos.count() == back.select("l_orderkey").distinct().count()


def test_stream_appends_once(spark, tmp_path):
    df = frame(spark, 20)
    Table.create(spark, f"{tmp_path}/t", df.schema)
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        append_stream(stream, f"{tmp_path}/t", f"{tmp_path}/ck").awaitTermination()
    assert Table.open(spark, f"{tmp_path}/t").read().count() == 20
    # another stream into the same table has batch numbers of its own
    append_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/ck2").awaitTermination()
    assert Table.open(spark, f"{tmp_path}/t").read().count() == 40


def test_files(spark, tmp_path):
    assert files.split_url("s3://b/k/x?y=1") == ("s3", "b", "/k/x", {"y": "1"})
    files.write_bytes(spark, f"{tmp_path}/f", b"abcdef")
    assert files.read_bytes(spark, f"{tmp_path}/f") == b"abcdef" and files.read_range(spark, f"{tmp_path}/f", 2, 3) == b"cde"
    files.copy(spark, f"{tmp_path}/f", f"{tmp_path}/g")
    assert not files.rename_new(spark, f"{tmp_path}/g", f"{tmp_path}/f") and files.exists(spark, f"{tmp_path}/g")
    with pytest.raises(ValueError):
        files.read_bytes(spark, "gopher://x/y")
