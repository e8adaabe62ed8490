"""The quality limits against the labels of the tables."""

from pyspark.sql import functions as F

from mnemospark.llm import quality_lm


def test_insults_and_junk_are_rejected(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_lm.classify(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    share = {(r.quality, r.toxic): r.kept / r.n for r in got.collect()}
    assert share[1, 0] >= 0.98 and share[1, 1] <= 0.4 and share[0, 0] <= 0.1
