"""Chunks of rows whose ids repeat or are null, and of very long documents."""

import time

from pyspark.sql import functions as F

from mnemospark.operators import chunking


def test_rows_dont_meet(spark):
    a, b = "Some words of it. " * 64, "Other words here! " * 390
    talk = "Why so?\nBecause of many things.\nWhat else?\nNothing that I would know of."
    md = "# One\n" + "body of the first one here\n" * 3 + "# Two\nshort"
    texts = [a, b, talk, md, None, ""]
    apart = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for ids in ([1] * 6, [None] * 6):
        same = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(2)
        for strategy in ("fixed", "sentence", "tree", "conversation", "auto"):
            told = lambda d: sorted((x.idx, x.title, x.text, x.strategy) for x in chunking.chunk(d, strategy).collect())
            assert told(same) == told(apart)
        assert sorted(x.strategy for x in chunking.detect(same).collect()) == sorted(x.strategy for x in chunking.detect(apart).collect())


def test_time_grows_with_the_length(spark):
    def took(n):
        d = spark.createDataFrame([(1, "Wört and other words. " * n)], "doc_id long, text string")
        t = time.time()
        for s in ("fixed", "sentence", "auto"):
            chunking.chunk(d, s).agg(F.count("*"), F.max("content_hash")).collect()
        return time.time() - t

    took(100)
    assert took(80_000) < 12 * took(20_000) + 5
