"""Operators on small made-up tables: arithmetic edges, ties, empty tables, the log's rules, readers, receipts."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import fixed_point as fx
from mnemospark.operators import bm25, cells, chunking, community, filters, graph, ingest, log, proofs, proximity, search, service, tree
from mnemospark.sources import files
from mnemospark.streaming import tail


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def floats(*xs):
    return F.array(*(F.lit(float(x)).cast("float") for x in xs))


def ints(*xs):
    return F.array(*(F.lit(x).cast("int") for x in xs))


# --- arithmetic -------------------------------------------------------------------------------------------------------


def test_quantize(spark):
    r = one(spark, a=fx.quantize(floats(1.5, -0.00002, 0.99999)), b=fx.quantize(floats(32768.0)), c=fx.quantize(floats(float("nan"))), d=fx.quantize(floats(-32768.0, 32767.98)))
    assert r.a == [98304, -1, 65535] and r.b is None and r.c is None and r.d[0] == -(2**31)
    r = one(spark, a=fx.quantize_round(floats(0.5 / 65536, -0.5 / 65536, float("inf"), float("-inf"), float("nan"), 1e9)), b=fx.quantize_cluster(floats(float("nan"), 1.0, 1e9)))
    assert r.a == [1, -1, 2147483520, -(2**31), -(2**31), 2147483520] and r.b == [0, 65536, 2**31 - 1]


def test_saturating_arithmetic(spark):
    big, low = F.lit(2**31 - 1), F.lit(-(2**31))
    r = one(spark, a=fx.fx_add(big, F.lit(1)), b=fx.fx_sub(low, F.lit(1)), c=fx.fx_mul(F.lit(-3), F.lit(1)), d=fx.fx_mul(big, big), e=fx.dequantize(ints(32768, -65536)))
    assert (r.a, r.b, r.c, r.d, r.e) == (2**31 - 1, -(2**31), -1, 2**31 - 1, [0.5, -1.0])


def test_vector_functions(spark):
    a, b = ints(65536, 0, -65536), ints(0, 65536)
    r = one(spark, l2=fx.l2_squared(a, ints(0, 65536, 0)), short=fx.l2_squared(a, b), dot=fx.fx_dot(a, ints(131072, 5, 0)), cos=fx.cosine(a, a), none=fx.cosine(a, ints(0, 0, 0)), bits=fx.binarize(ints(*([1, -1] * 40))), h=fx.hamming(F.array(F.lit(5).cast("long")), F.array(F.lit(3).cast("long"))), s=fx.similarity(F.lit(1.0)))
    assert r.l2 == 3 * 65536**2 and r.short == 2 * 65536**2 and r.dot == 131072 and abs(r.cos - 1) < 1e-12 and r.none is None
    assert r.bits == [0x5555555555555555, 0x5555] and r.h == 2 and r.s == 0.5
    q = one(spark, c=fx.scalar_quantize(floats(-2, -1, 0, 1, 3)), d=fx.scalar_dequantize(ints(0, 255)))
    assert q.c == [0, 0, 127, 255, 255] and q.d == [-1.0, 1.0]


# --- search -----------------------------------------------------------------------------------------------------------


def table(spark, n=300, dim=8, seed=1, high=50):
    r = random.Random(seed)
    return spark.createDataFrame([(i, [r.randint(-high, high) for _ in range(dim)], i % 3, i % 4, 0) for i in range(n)], "id long, fx array<int>, tag long, namespace_id int, flags int")


def brute(rows, q, k):
    return sorted((sum((x - y) ** 2 for x, y in zip(v, q)), i) for i, v in rows)[:k]


def test_exact_search_and_batches(spark):
    t = table(spark, high=2)  # many ties
    rows = [(r.id, r.fx) for r in t.collect()]
    q = t.where("id in (3, 9, 200)").select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    got = search.batch_nearest(t.repartition(5), q, 7).collect()
    for x in q.collect():
        assert [(r.dist, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == x.qid] == brute(rows, x.q, 7)
    single = search.nearest(t, q.where("qid = 9"), 5).collect()
    assert [(r.dist, r.id) for r in single] == brute(rows, dict(rows)[9], 5)
    assert search.nearest(t, q, 0).count() == 0 and search.nearest(t.where("id < 4"), q, 50).count() == 4
    assert search.batch_nearest(t.where("false"), q, 3).count() == 0 and search.batch_nearest(t, q.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        search.batch_nearest(t, spark.createDataFrame([(1, [1]), (2, [1, 2])], "qid long, q array<int>"), 3)


def test_distances_saturate():
    a = np.array([[2**31 - 1, -(2**31)] * 3], np.int64)
    assert search.distances(a, -a)[0, 0] == 2**63 - 1
    assert search.distances(np.array([[1, 2]]), np.array([[4, 6]]))[0, 0] == 25


def test_blocks_of_queries(spark, monkeypatch):
    t = table(spark, 80)
    q = t.select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    whole = sorted(map(tuple, search.batch_nearest(t, q, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 500)
    assert sorted(map(tuple, search.batch_nearest(t, q, 3).collect())) == whole


def test_two_stage_and_tiers(spark):
    t = table(spark)
    q = t.where("id = 5").select(F.col("fx").alias("q"))
    assert [r.id for r in search.signs_search(t, q, 5, least=300).collect()] == [r.id for r in search.nearest(t, q, 5).collect()]
    assert [search.tier(n) for n in (10, 10_000, 2_000_000)] == ["brute", "signs", "cells"]
    assert search.overfetch(10) == 10 and search.overfetch(10, filtered=True) == 100 and search.overfetch(1000, filtered=True) == 5000 and search.overfetch(5, rerank=True) == 100 and search.overfetch(10, decay=True) == 50


def test_search_is_exact_beyond_the_first_tier(spark):
    """The nearest records differ from the query in both signs, thousands of far ones in none."""
    n = F.col("id")
    x = F.when(n < 5, -1 - n).otherwise(n + 10).cast("int")
    t = spark.range(search.BRUTE_BELOW).select("id", F.array(x, x).alias("fx"))
    q = spark.range(1).select(ints(1, 1).alias("q"))
    want = [(k, 2 * (2 + k) ** 2) for k in range(5)]
    assert [tuple(r) for r in search.search(t, q, 5).collect()] == want
    missed = [tuple(r) for r in search.search(t, q, 5, approximate=True).collect()]
    assert missed == [(k, 2 * (9 + k) ** 2) for k in range(5, 10)]


def test_kmeans_matches_plain_steps(spark):
    t = table(spark, 120, 3)
    rows = {r.id: np.array(r.fx, np.int64) for r in t.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    h = cells.seed_hashes(x, ids)
    order = sorted(range(len(ids)), key=lambda i: (int(h[i]), ids[i]))[:6]
    c = x[order]
    for _ in range(4):
        at = cells.assign(x, c)
        moved = np.array([[int(math.trunc(v / len(m))) if True else 0 for v in m.sum(0)] if len(m := x[at == k]) else c[k] for k in range(6)])
        if (moved == c).all():
            break
        c = moved
    assert (cells.kmeans(t.repartition(4), 6, 4) == c).all()
    assert len(cells.kmeans(t.where("id < 4"), 6)) == 4 and cells.kmeans(t.where("false"), 6).size == 0
    # the published constants of FNV-1a over a known input
    want = 0xCBF29CE484222325
    for b in np.array([7, -1], "<i4").tobytes() + np.array([3], "<u4").tobytes():
        want = ((want ^ b) * 0x100000001B3) % 2**64
    assert int(cells.seed_hashes(np.array([[7, -1]]), np.array([3]))[0]) == want


def test_cells_of_all_is_exact(spark, tmp_path):
    t = table(spark)
    index = cells.build(t, 16, iterations=3)
    q = t.where("id < 5").select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.dist) for r in df.collect())
    assert key(cells.probe(index, q, 4, probes=16)) == key(search.batch_nearest(t, q, 4))
    path = f"{tmp_path}/cells"
    cells.save(index, path)
    loaded = cells.load(spark, path)
    assert loaded.records.count() == 300 and key(cells.probe(loaded, q, 4)) == key(cells.probe(index, q, 4))
    assert "PartitionFilters: [isnotnull(cell" in loaded.records.where("cell = 3")._jdf.queryExecution().toString()


def test_cells_change(spark, tmp_path):
    t, path = table(spark), f"{tmp_path}/cells"
    q = t.where("id < 5").select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.dist) for r in df.collect())
    cells.save(cells.build(t.where("false")), path)
    assert cells.load(spark, path).records.count() == 0 and cells.probe(cells.load(spark, path), q, 4).count() == 0
    cells.insert(spark, path, t.where("id < 200"))
    assert key(cells.probe(cells.load(spark, path), q, 4)) == key(search.batch_nearest(t.where("id < 200"), q, 4))  # before there are cells
    assert len(cells.rebuild(spark, path).centroids) >= 16
    cells.insert(spark, path, t.where("id >= 200"))
    cells.delete(spark, path, t.where("id in (1, 250)").select("id"))
    left = t.where("id not in (1, 250)")
    assert key(cells.probe(cells.load(spark, path), q, 4, probes=99)) == key(search.batch_nearest(left, q, 4))
    assert cells.rebuild(spark, path).records.count() == 298


def test_calibrated_recall(spark):
    t = table(spark, 3000, 16)
    index = cells.build(t, iterations=5)
    q = t.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    got = {(r.qid, r.id) for r in cells.probe(index, q, 10).collect()}
    want = {(r.qid, r.id) for r in search.batch_nearest(t, q, 10).collect()}
    assert len(got & want) >= 0.9 * len(want) and index.probes < len(index.centroids)


@pytest.mark.parametrize("top", [1 << 15, 1 << 20, 1 << 30])
def test_products_are_exact(top):
    r = np.random.default_rng(top)
    a, b = (r.integers(-top, top, (40, 7)) for _ in range(2))
    assert (search.dots(a, b) == a @ b.T).all()
    d = r.integers(0, 5, (6, 50))
    ids = r.permutation(50)
    for k in (1, 7, 50, 60):
        row, at = search.least(d, ids, k)
        want = [(i, int(j)) for i in range(6) for j in sorted(range(50), key=lambda j: (d[i, j], ids[j]))[:k]]
        assert list(zip(row.tolist(), at.tolist())) == want


def test_proximity_graphs(spark, tmp_path):
    t = table(spark, 600, 8, high=200)
    q = t.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("fx").alias("q"))
    graph_ = proximity.build(t.repartition(5), 200)
    proximity.save(graph_, f"{tmp_path}/graphs")
    graph_ = proximity.load(spark, f"{tmp_path}/graphs")
    g = graph_.table
    assert g.where("layer = 0").count() == 600 and g.where("layer = 0").groupBy("cell", "shard").count().agg(F.max("count")).first()[0] <= 200
    assert g.agg(F.max(F.size("neighbours"))).first()[0] <= proximity.GROUND_LINKS
    got = {(r.qid, r.id) for r in proximity.search(graph_, q, 10).collect()}
    want = {(r.qid, r.id) for r in search.batch_nearest(t, q, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert sorted(map(tuple, proximity.search(graph_, q, 3).collect())) == sorted(map(tuple, proximity.search(proximity.build(t, 200), q, 3).collect()))
    assert proximity.build(t.where("false")).table.count() == 0 and proximity.search(proximity.build(t.where("false")), q, 3).count() == 0


def test_decay(spark):
    hits = spark.createDataFrame([(1, 1.0, 900), (2, 1.4, 1000), (3, 1.0, None), (4, 1.0, 5000)], "id long, distance double, created_at long")
    got = search.decay_rerank(hits, 1000, 100, 10).collect()
    assert [r.id for r in got] == [3, 4, 2, 1] and got[-1].factor == 0.5
    assert [r.id for r in search.decay_rerank(hits, 1000, 0, 2).collect()] == [1, 3]


# --- filters ----------------------------------------------------------------------------------------------------------

META = ['{"a":1,"b":"x","n":{"k":[1,2]},"y":2021}', '{"a":1.0}', '{"a":"1"}', '{"a":null,"y":"2021"}', "not json", None, '{"a":true,"o\'k":1}', '{"a":1,"b":"x","n":{"k":[2,1]},"y":2019.5}']


@pytest.mark.parametrize(
    ("cond", "want"),
    [({"a": 1}, [0, 7]), ({"a": 1.0}, [1]), ({"a": "1"}, [2]), ({"a": None}, [3]), ({"a": True}, [6]), ({"a": 1, "b": "x"}, [0, 7]), ({"n": {"k": [1, 2]}}, [0]), ({"y": {"gte": 2020}}, [0]), ({"y": {"lt": 2020, "gt": 2019}}, [7]),
     ({"y": {"gte": "x"}}, [0, 7]), ({"y": {"eq": "x"}}, []), ({"y": {"eq": 2021}}, [0]), ({"a": {"like": 1}}, []), ({"z": 1}, []), ({}, list(range(8))), ({"o'k": 1}, [6]), ({"o'\"k": 1}, [])],
)
def test_metadata_filter(spark, cond, want):
    t = spark.createDataFrame(list(enumerate(META)), "id int, meta string")
    assert sorted(r.id for r in t.where(filters.matches(F.col("meta"), cond)).collect()) == want


# --- text -------------------------------------------------------------------------------------------------------------


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the AdamW optimizer for pretraining"), (2, "fruit salad"), (3, "optimizer optimizer notes"), (4, None), (5, "héllo é b a9")], "id long, text string")
    assert docs.where("id = 5").select(bm25.tokens(F.col("text"))).first()[0] == ["héllo", "é", "a9"]
    got = {r.id: r.bm25 for r in bm25.scores(docs, bm25.query_terms(spark, "AdamW optimizer optimizer")).collect()}
    n, avg = 5, (5 + 2 + 3 + 0 + 3) / 5
    idf = lambda df: max(0, math.log((n - df + 0.5) / (df + 0.5) + 1))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got.keys() == {1, 3} and abs(got[1] - idf(1) * part(1, 5) - 2 * idf(2) * part(1, 5)) < 1e-9 and abs(got[3] - 2 * idf(2) * part(2, 3)) < 1e-9
    hits = spark.createDataFrame([(2, 1.0, 1), (1, 1.5, 2), (3, 2.0, 3)], "id long, distance double, rank int")
    assert [r.id for r in bm25.hybrid(hits, docs, "AdamW optimizer pretraining", 3).collect()][0] == 1
    assert [r.id for r in bm25.hybrid(hits, docs, "?", 3).collect()] == [2, 1, 3]
    same = hits.withColumn("distance", F.lit(1.0))
    assert [r.id for r in bm25.hybrid(same, docs, "fruit", 3).collect()][0] == 2


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_fixed(text, size, overlap):
    """Windows told step by step."""
    text = "\n".join(line.rstrip() for line in (text or "").replace("\r\n", "\n").split("\n"))
    size = max(size, 50)
    step = size - min(overlap, size // 2)
    out, a = [], 0
    while a < len(text):
        z = min(a + size, len(text))
        if z < len(text):
            ahead = next((i + 1 for i in range(z, min(z + 80, len(text))) if text[i] in ".!?\n"), None)
            behind = next((i + 1 for i in range(z - 1, max(z - 80, 0) - 1, -1) if text[i] in ".!?\n"), None)
            z = ahead or behind or z
        piece = text[a:z].strip()
        if len(piece.encode()) >= 30:
            out.append(piece)
        if z >= len(text):
            break
        a += step
    return out


def test_fixed_windows(spark):
    r = random.Random(3)
    texts = ["a" * 3000, "", None, "short", "x. " * 400, *("".join(r.choice("abc  .\n!é日") for _ in range(r.randint(0, 900))) for _ in range(30))]
    for size, overlap in ((1000, 200), (60, 50), (10, 3)):
        got = {}
        for x in chunking.fixed(docs_of(spark, *texts), size, overlap).orderBy("doc_id", "idx").collect():
            got.setdefault(x.doc_id, []).append(x.text)
        for i, t in enumerate(texts):
            assert got.get(i, []) == plain_fixed(t, size, overlap), (i, t)


def test_sentences(spark):
    t = 'One two three four. Five six. Seven eight nine ten! "Is it so?" he asked them all. e.g. this one stays 3.5 high. End'
    got = docs_of(spark, t, "", None, "no stop at all").select("doc_id", chunking.sentences(chunking.normalise(F.col("text"))).alias("s")).collect()
    assert got[0].s == ["One two three four.", "Five six. Seven eight nine ten!", '"Is it so?" he asked them all. e.g. this one stays 3.5 high.', "End"]
    assert got[1].s == [] and got[2].s == [] and got[3].s == ["no stop at all"]
    w = chunking.sentence_windows(docs_of(spark, t)).orderBy("idx").collect()
    assert len(w) == 4 and w[0].text == " ".join(got[0].s[:3]) and w[3].text == " ".join(got[0].s[1:])


MARKDOWN = "intro\n# Handbook\nWelcome to all of it.\n## Annual Leave\nYou get 25 days. More text here for length.\n```\n# not a header\n```\n### Sick Leave\nCall in sick! Then rest for a while at home.\n## Pay\nMonthly.\n"


def test_sections_and_detection(spark):
    d = docs_of(spark, MARKDOWN, "plain prose. " * 20, "00:01\nhello there\n00:05\nyes yes\n", "1. Intro\n" + "words " * 20 + "\n2.1 Next Part\nends here.")
    s = chunking.sections(d).orderBy("doc_id", "idx").collect()
    assert [(x.doc_id, x.title) for x in s] == [(0, "## Annual Leave"), (0, "### Sick Leave"), (0, "## Pay"), (3, "1. Intro"), (3, "2.1 Next Part")]
    assert {x.doc_id: x.strategy for x in chunking.detect(d).collect()} == {0: "tree", 1: "fixed", 2: "conversation", 3: "tree"}
    assert {x.doc_id: x.strategy for x in chunking.chunk(d, "tree").collect()} == {0: "tree", 1: "tree->fixed", 2: "tree->fixed", 3: "tree"}


def test_conversations(spark):
    t = "Host opens the show with a long welcome.\n0:01\nHow do you do it every day?\nWith patience and care.\nAnd why?\n12:30\nBecause it matters to me.\nReally?\nYes"
    got = chunking.conversation(docs_of(spark, t, "no questions here at all, just one line of text")).orderBy("doc_id", "idx").collect()
    assert [(x.title, x.text) for x in got if x.doc_id == 0] == [
        ("Introduction", "Host opens the show with a long welcome."), ("How do you do it every day?", "How do you do it every day? With patience and care."), ("And why?", "And why? Because it matters to me."),
    ]
    assert [x.text for x in got if x.doc_id == 1] == ["no questions here at all, just one line of text"]


def test_splitters(spark):
    t = "One. Two? " + "x" * 25 + ".\n\nNext para."
    r = docs_of(spark, t, None).select(chunking.split_sentences(F.col("text"), 10).alias("s"), chunking.split_paragraphs(F.col("text"), 30).alias("p")).collect()
    assert r[0].s == ["One.", "Two?", "x" * 10, "x" * 10, "x" * 5 + ".", "Next para."]
    assert r[0].p[:2] == ["One.", "Two?"] and r[0].p[-1] == "Next para." and r[1].s == [] and r[1].p == []


def test_tree(spark):
    n = tree.build(docs_of(spark, MARKDOWN, "no headers", None))
    rows = {r.node_id: r for r in n.collect()}
    assert [(r.title, r.level, r.start_line, r.end_line, r.parent) for _, r in sorted(rows.items())] == [("Handbook", 1, 2, 3, None), ("Annual Leave", 2, 4, 8, "0001"), ("Sick Leave", 3, 9, 10, "0002"), ("Pay", 2, 11, 13, "0001")]
    assert rows["0003"].summary == "Call in sick!" and rows["0004"].summary == "Monthly."
    ranked = tree.rank(n, "How much sick leave can I get").collect()
    assert [(r.node_id, r.score) for r in ranked] == [("0003", 13.3), ("0002", 5.2)]
    crumbs = {r.node_id: r.breadcrumb for r in tree.breadcrumbs(n).collect()}
    assert crumbs["0003"] == "Handbook > Annual Leave > Sick Leave"
    assert tree.rank(n, "the of and").count() == 0


# --- log --------------------------------------------------------------------------------------------------------------


def events(spark, *rows):
    names = [c.split()[0] for c in log.COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(({"log_index": i, "ts": 100 + i, "namespace_id": 0} | r).get(n) for n in names) for i, r in enumerate(rows)], log.COLUMNS)


def test_fold(spark):
    e = events(
        spark, {"event_type": "SoftDelete", "record_id": 0}, {"event_type": "InsertRecord", "record_id": 0, "fx": [1], "metadata": "a"}, {"event_type": "InsertRecord", "record_id": 1, "namespace_id": 2, "fx": [2]},
        {"event_type": "UpdateMetadata", "record_id": 0, "metadata": "b"}, {"event_type": "InsertEncrypted", "record_id": 2, "metadata": "ct", "key_id": "k"}, {"event_type": "InsertRecord", "record_id": 3, "fx": [3]}, {"event_type": "HardDelete", "record_id": 3},
        {"event_type": "DropNamespace", "namespace_id": 2}, {"event_type": "InsertRecord", "record_id": 4, "namespace_id": 2, "fx": [4]}, {"event_type": "ShredKey", "key_id": "k"}, {"event_type": "SoftDelete", "record_id": 4},
        {"event_type": "CreateNode", "node_id": 0, "kind": 0, "record_id": 0}, {"event_type": "CreateNode", "node_id": 1, "kind": 6}, {"event_type": "CreateEdge", "edge_id": 0, "kind": 6, "src": 0, "dst": 1}, {"event_type": "CreateEdge", "edge_id": 1, "kind": 6, "src": 0, "dst": 0},
        {"event_type": "DeleteNode", "node_id": 1}, {"event_type": "SetMeta", "key": "x", "value": "1"}, {"event_type": "SetMeta", "key": "x", "value": "2"}, {"event_type": "DropNamespace", "namespace_id": 0},
    )
    s = log.fold(e)
    assert {r.id: (r.namespace_id, r.flags, r.metadata) for r in s.records.collect()} == {0: (0, 0, "b"), 2: (0, 6, None), 4: (2, 1, None)}
    assert [r.id for r in s.nodes.collect()] == [0] and [r.id for r in s.edges.collect()] == [1] and [tuple(r) for r in s.meta.collect()] == [("x", "2")]
    assert {r.id for r in log.fold(log.as_of_index(e, 5)).records.collect()} == {0, 1, 2, 3}
    assert log.as_of_time(e, 99).count() == 0 and log.as_of_time(e, 103).count() == 4 and log.index_at(e, 103) == 3
    with pytest.raises(ValueError):
        log.as_of_index(e, 99)
    empty = log.fold(e.where("false"))
    assert empty.records.count() == empty.nodes.count() == empty.edges.count() == empty.meta.count() == 0


def test_timeline_and_dedup(spark):
    e = events(spark, {"event_type": "SetMeta", "request_id": "a"}, {"event_type": "SetMeta"}, {"event_type": "SetMeta", "request_id": "a"}, {"event_type": "SetMeta"})
    assert [r.log_index for r in log.dedup_requests(e).orderBy("log_index").collect()] == [0, 1, 3]
    assert log.parse_time("1970-01-01T00:01:41Z") == 101 and log.parse_time("nonsense") is None
    assert log.timeline(e, "1970-01-01T00:01:41Z", "nonsense").count() == 3 and log.timeline(e, 101, 102).count() == 2


def test_numbering(spark):
    t = spark.createDataFrame([(k * 7,) for k in range(100)], "x long").repartition(5)
    got = {r.x: r.id for r in log.number(t, "x", width=50).collect()}
    assert got == {k * 7: k for k in range(100)}


def test_rejects(spark):
    e = events(spark, {"event_type": "InsertRecord", "record_id": 0, "fx": [1, 2]}, {"event_type": "InsertRecord", "record_id": 1, "fx": [1]}, {"event_type": "InsertRecord", "record_id": 2, "fx": [1, 2], "namespace_id": 1024}, {"event_type": "InsertRecord", "record_id": 9, "fx": [1, 2]}, {"event_type": "InsertRecord", "record_id": 4, "fx": [1, 2], "metadata": "x" * 70000})
    assert {r.log_index: r.reason for r in log.rejects(e).collect()} == {1: "dimension", 2: "namespace", 3: "order", 4: "metadata"}


# --- graph ------------------------------------------------------------------------------------------------------------


def test_reach_against_search(spark):
    r = random.Random(7)
    nodes = [(i, 0, i if i % 2 else None, i % 2) for i in range(60)]
    links = [(k, 0, r.randrange(60), r.randrange(64)) for k in range(90)]
    n, e = spark.createDataFrame(nodes, "id long, kind int, record_id long, namespace_id int"), spark.createDataFrame(links, "id long, kind int, src long, dst long")
    seeds = spark.createDataFrame([(0,), (5,), (5,), (999,)], "id long")
    for depth in (0, 1, 3):
        dist, front = {0: 0, 5: 0}, [0, 5]
        for step in range(1, depth + 1):
            front = [d for s in front for _, _, a, d in links if a == s and d < 60 and d not in dist and not dist.update({d: step})]
        near, inner = graph.subgraph(n, e, seeds, depth)
        assert {x.id: x.dist for x in near.collect()} == dist
        assert {x.id for x in inner.collect()} == {k for k, _, a, _ in links if dist.get(a, 9) < depth}
    assert graph.subgraph(n, e, seeds, 9)[0].count() == graph.reach(n, e, seeds, 4).count()
    gone_n, gone_e = graph.delete_nodes(n, e, spark.createDataFrame([(0,)], "id long"))
    assert gone_n.count() == 59 and gone_e.count() == sum(a != 0 and d != 0 for _, _, a, d in links)
    assert graph.valid_edges(e, n).count() == sum(d < 60 and a % 2 == d % 2 for _, _, a, d in links)
    assert {x.record_id: x.node_id for x in graph.node_of_record(n).collect()} == {i: i for i in range(60) if i % 2}


def test_label_propagation(spark):
    r = random.Random(3)
    nodes = list(range(50))
    links = [(r.randrange(50), r.randrange(50)) for _ in range(60)] + [(3, 3)]
    n = spark.createDataFrame([(i, 0, i, 0) for i in nodes], "id long, kind int, record_id long, namespace_id int")
    e = spark.createDataFrame([(k, 0, a, b) for k, (a, b) in enumerate(links)], "id long, kind int, src long, dst long")
    assert {x.id: x.community for x in community.detect(n, e).collect()} == community.propagate(nodes, links)
    # components over the limit are settled by joins, halves of the ids in turn
    half = {x.id: x.h for x in n.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    near, comp = {i: [] for i in nodes}, {i: i for i in nodes}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    for _ in nodes:
        comp = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in nodes}
    size = {c: sum(comp[i] == c for i in nodes) + sum(comp[a] == c for a, _ in links) for c in set(comp.values())}
    label = {i: i for i in nodes}
    for _ in range(20):
        for h in (0, 1):
            now = dict(label)
            for i in nodes:
                if near[i] and half[i] == h:
                    votes = [label[j] for j in near[i]]
                    now[i] = min(set(votes), key=lambda c: (-votes.count(c), c))
            label = now
    want = {i: label[i] if size[comp[i]] > 6 else c for i, c in community.propagate(nodes, links).items()}
    assert {x.id: x.community for x in community.detect(n, e, largest=6).collect()} == want
    assert community.detect(n.withColumn("namespace_id", (F.col("id") % 2).cast("int")), e, namespace=1).count() == 25
    assert community.propagate([1, 2, 3], [(1, 2)]) == {1: 2, 2: 2, 3: 3}


def test_names_resolve(spark):
    rel = spark.createDataFrame([("a", "b", "l"), ("a", "zz", "l"), (None, "b", "l")], "source string, target string, label string")
    ent = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, id long")
    edges, counts = graph.resolve_names(rel, ent)
    assert [tuple(x) for x in edges.collect()] == [(1, 2, "l")] and tuple(counts.first()) == (1, 2)


# --- proofs -----------------------------------------------------------------------------------------------------------


def test_chain_breaks_are_found(spark):
    rows = spark.createDataFrame([(i, f"d{i}") for i in range(20)], "i long, digest string")
    seg = F.floor(F.col("i") / 7)
    chained = proofs.chain(rows, seg)
    assert proofs.broken(chained, rows, seg).count() == 0
    bad = rows.where("i <> 12").withColumn("digest", F.when(F.col("i") == 3, "zz").otherwise(F.col("digest")))
    assert {(r.i, r.reason) for r in proofs.broken(chained, bad, seg).collect()} == {(3, "digest"), (12, "missing")}
    forged = chained.withColumn("prev_hash", F.when(F.col("i") == 16, "x").otherwise(F.col("prev_hash")))
    assert {(r.i, r.reason) for r in proofs.broken(forged, rows, seg).collect()} == {(16, "link")}


def test_merkle(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def root(v):
        level = [sha(f"LEAF:{i}:{x}") for i, x in enumerate(v)]
        while len(level) > 1:
            level = [sha(f"NODE:{level[k]}:{level[k + 1] if k + 1 < len(level) else level[k]}") for k in range(0, len(level), 2)]
        return level[0] if level else None

    vs = [[1], [1, 2], [5, -3, 7], list(range(13)), []]
    t = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id int, v array<int>")
    assert {r.id: r.root for r in t.select("id", proofs.merkle_root(F.col("v")).alias("root")).collect()} == {i: root(v) for i, v in enumerate(vs)}


def test_state_hash_sees_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, v string")
    h = lambda d: proofs.state_hash(d, "id", ["v"], width=2).first()[0]
    assert h(t) == h(t.repartition(3)) and len({h(t), h(t.where("id < 3")), h(t.withColumn("v", F.coalesce("v", F.lit(""))))}) == 3


# --- ingest and sources -----------------------------------------------------------------------------------------------


def test_difference_is_a_multiset(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z")], "doc_id long, content_hash string")
    new = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c"), (3, "q")], "doc_id long, content_hash string")
    assert {(r.doc_id, r.content_hash, r.action): r.n for r in ingest.difference(old, new).collect()} == {(1, "a", "keep"): 1, (1, "a", "remove"): 1, (1, "b", "remove"): 1, (1, "c", "add"): 2, (2, "z", "remove"): 1, (3, "q", "add"): 1}


def test_embeddings():
    import hashlib

    v = ingest.hash_embedding("foo", 40)
    first = hashlib.sha256(hashlib.sha256(b"foo").digest() + (0).to_bytes(4, "little")).digest()
    assert len(v) == 40 and v[0] == first[0] / 127.5 - 1 and v != ingest.hash_embedding("bar", 40) and ingest.zero_embedding("x", 3) == [0.0] * 3


def test_validation(spark):
    t = spark.createDataFrame([(0, " \n", "text/plain", 1), (1, "x" * 30, "text/plain", 1), (2, "ok", "text/plain", 9), (3, "ok", "application/pdf+protected", 1), (4, None, "text/plain", None), (5, "ok", "text/plain", None)], "i int, t string, m string, p int")
    got = {r.i: r.e for r in t.select("i", ingest.validation_error(F.col("t"), F.col("m"), F.col("p"), max_bytes=20, max_pages=5).alias("e")).collect()}
    assert got == {0: "empty", 1: "too_large", 2: "too_many_pages", 3: "protected", 4: "empty", 5: None}


def test_readers():
    page = '<html><head><title> T &amp; t</title><meta name="author" content=" Ann "><style>p{}</style></head><body><h1> Head </h1><script>x()</script><p>One <b>two</b></p><noscript>no</noscript></body></html>'
    assert files.parse_html(page) == ("Head One two", "T & t", "Ann")
    assert files.parse_html("") == ("", None, None)
    text, title = files.parse_markdown("# Top *one*\n\nA **bold** [link](http://x) and `code`.\n\n- item\n1. two\n\n```\nraw # x\n```\n")
    assert title == "Top one" and text == "Top one\nA bold link and code.\nitem\ntwo\nraw # x"


def test_docx(tmp_path, spark):
    import zipfile

    w, c = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.org/dc/elements/1.1/"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p><w:r><w:t>Next</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", f'<cp xmlns:dc="{c}"><dc:title>My title</dc:title><dc:creator>Ann</dc:creator></cp>')
    r = files.read_docx(spark, str(tmp_path / "a.docx")).first()
    assert (r.body, r.title, r.author) == ("Hello world\nNext", "My title", "Ann")


def test_jsonl(tmp_path, spark):
    lines = [{"vector": [1, 2], "metadata": "m", "tag": 3}, {"embedding": [0.5], "text": "t"}, {"values": [1.0], "payload": "p", "request_id": "r"}, {"text": "no vector"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken {\n")
    got = sorted((r.vec, r.metadata, r.tag, r.request_id) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect())
    assert [g[1] for g in got] == ["t", "p", "m"] and got[2][2] == 3 and got[0][2] == 0


def test_formats(spark):
    t = spark.createDataFrame([("a.MD", None, None), ("b", "text/html", None), ("c", "odd/type", bytearray(b"%PDF-1.7")), ("d", None, bytearray(b"PK\x03\x04")), ("e.bin", None, None)], "p string, m string, h binary")
    assert [r[0] for r in t.select(files.format_of(F.col("p"), F.col("m"), F.col("h"))).collect()] == ["markdown", "html", "pdf", "docx", "text"]


def test_paged_refuses_other_dimensions(spark):
    pages = {None: ([{"id": 1, "vector": [1.0, 2.0]}], "n"), "n": ([{"id": 2, "vector": [1.0]}], None)}
    it = files.read_paged(spark, lambda c: pages[c])
    assert next(it).first().metadata == "{}"
    with pytest.raises(ValueError):
        next(it)


# --- service and streams ----------------------------------------------------------------------------------------------


def test_find_options(spark):
    t = table(spark, 40).withColumn("metadata", F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}"))).withColumn("created_at", F.col("id") * 10).withColumn("flags", F.when(F.col("id") == 8, 1).otherwise(0))
    q = t.where("id = 4").select(F.col("fx").alias("q"))
    rows = [(r.id, r.fx) for r in t.collect()]
    want = [i for _, i in brute([(i, v) for i, v in rows if i % 4 == 0 and i != 8 and i >= 4], dict(rows)[4], 5)]
    assert [r.id for r in service.find(t, q, 5, namespace=0, metadata={"k": {"gte": 4}}).orderBy("position").collect()] == want
    assert service.find(t, q, 5, tag=99).count() == 0 and service.find(t.where("false"), q, 5).count() == 0
    docs = t.select("id", F.when(F.col("id") == 11, "rare words here").otherwise("plain").alias("text"))
    assert service.find(t, q, 40, docs=docs, text="rare").orderBy("position").limit(2).where("id = 11").count() == 1
    names = spark.createDataFrame([("a", 3)], "name string, namespace_id int")
    assert service.resolve_collection(names, "a") == 3 and service.resolve_collection(names, None) == 0
    with pytest.raises(LookupError):
        service.resolve_collection(names, "b")
    assert "TakeOrderedAndProject" in service.explain(search.nearest(t, q, 3))["operators"] or service.explain(search.nearest(t, q, 3))["adaptive"]


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark, *({"event_type": "SetMeta", "key": f"k{i % 3}", "value": str(i), "request_id": f"r{i % 12}"} for i in range(30)))
    e.repartition(4).write.parquet(f"{tmp_path}/log")
    tail.apply(tail.follow(spark, f"{tmp_path}/log", after=9, files=1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.log_index for r in got.collect()) == list(range(10, 30))
    a = {r.key: r.value for r in log.fold(got.select(*e.columns)).meta.collect()}
    assert a == {r.key: r.value for r in log.fold(e.where("log_index > 9")).meta.collect()}


def test_plans(spark, sf):
    """The scans read what they need, and filters reach them."""
    from mnemospark.plans import vectors

    plan = vectors.knn_tag(spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    plan = vectors.meta_filter_exact(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan
