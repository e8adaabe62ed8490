"""The pipeline's stages on awkward tables, and all of it on the small one."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_operators import SCHEMA, awkward_rows, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    good = [(i, prose(150, i), "en", "s", 1) for i in range(100, 200)]
    leak = prose(40, 90000)
    shared = prose(60, 91000)
    copy = good[3][1].split()
    copy[10] = "changed"
    extra = [(500, " ".join(copy), "en", "s", 1), (501, prose(80, 501) + " " + leak + " " + prose(50, 502), "en", "s", 1), (502, prose(90, 503) + " " + shared, "en", "s", 1), (503, shared + " " + prose(200, 504), "en", "s", 1), (504, "@#$%" * 200, "en", "s", 1)]
    rows = [*good, *extra, *awkward_rows()]
    spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100, 190)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, shared


def test_stages_take_effect(spark, tables):
    d, shared = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "quality classifier":
            assert 504 not in ids and 4 not in ids and {100, 150, 199, 500, 501} <= {*ids}
        if name == "near-duplicate removal":
            assert 500 not in ids and 103 in ids and 1 not in ids and 0 in ids
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        if name == "substring deduplication":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert shared not in texts[502] and shared not in texts[503] and texts[100] == prose(150, 100)
        if name == "benchmark decontamination":
            assert 501 not in ids and 502 in ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert out.count() == docs.count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    total = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * total < out.count() < total


def test_empty(spark, tables, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
