"""Near duplicates where ids repeat or are null."""

import corpus_pipeline

from .test_operators import SCHEMA, prose


def test_texts_under_one_id_stay_apart(spark):
    a, b, c, e = prose(150, 1), prose(150, 2), prose(150, 3), prose(150, 4)
    near = lambda t: t + " extra"
    rows = [(3, near(a)), (5, a), (5, b), (None, c), (None, near(c)), (None, near(e)), (9, e), (None, prose(150, 6))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {(3, near(a)), (5, b), (9, e), (None, prose(150, 6))} <= got
    assert (5, a) not in got and (None, near(e)) not in got
    assert ((None, c) in got) != ((None, near(c)) in got) and len(got) == 5


def test_substrings_of_rows_that_look_alike(spark):
    from mnemospark.llm.substring_dedup import remove_duplicates

    p = prose(60, 8)
    rows = [("5", None), (None, "5"), (None, p), (None, p), ("5", p), ("5", p + " tail"), (p, None), (None, prose(50, 9))]
    got = sorted((r.n_words, r.n_removed) for r in remove_duplicates(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect())
    assert got == sorted([(0, 0), (1, 0), *[(60, 60)] * 3, (61, 60), (0, 0), (50, 0)])


def test_nodes_that_are_not_broadcast_give_the_same(spark, monkeypatch):
    from mnemospark.llm import near_dups

    from .test_operators import near_rows

    docs = spark.createDataFrame(near_rows(), "doc_id long, text string").repartition(3)
    told = lambda: sorted(map(tuple, near_dups.near_duplicates(docs, leaf=6).collect()))
    first = told()
    monkeypatch.setattr(near_dups, "BROADCAST_LIMIT_BYTES", -1)
    assert told() == first
