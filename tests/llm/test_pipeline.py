"""Every stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_dedup import plain_exact, plain_near
from tidelake.llm import quality
from tidelake.llm.queries import quality_model


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in out.collect()}, out.columns)
        docs = out
    for name, (_, _, columns) in list(seen.items())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    before, after, _ = seen["exact_dedup"]
    assert after == {r[0] for r in plain_exact(list(before.items())) if r[3]}
    before, after, _ = seen["near_dedup"]
    assert after == {i for i, r in plain_near(list(before.items()), 80).items() if r[2]}
    before, after, _ = seen["decontamination"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i, t in before.items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert before.keys() - after == holds
    before, after, _ = seen["sentencepiece"]
    assert before.keys() == after
    before, after, _ = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ({i for i, q in labels.items() if q == v and i in before} for v in (1, 0))
    assert len(good & after) >= 0.95 * len(good) and len(bad & after) <= 0.25 * len(bad)


def test_run_and_null_columns(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= 2, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_model_ignores_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model(docs, labels), quality_model(docs, flipped)
    assert (a.weights == b.weights).all() and isinstance(a, quality.PuModel)


def test_exact_stage_of_repeated_and_missing_ids(spark, sf):
    rows = [(None, "a b"), (None, "A b"), (5, "c d"), (5, "c d"), (5, "other"), (7, "e"), (8, "E"), (9, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.exact_dedup_stage(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(None, "a b"), (5, "c d"), (5, "other"), (8, "e"), (9, "")], key=repr)
