"""Registered vector queries: arithmetic, exact and two-stage search, cells, decay, filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from ..functions.lineage import shared_folder
from ..operators import cells, evaluation, filters, proximity, search

#: Records get a creation time of one hour per id from here on; reads take this time as now.
EPOCH = 1_700_000_000
NOW, HALF_LIFE = EPOCH + 400 * 3600, 36_000


def records(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings table as records: the label is the tag, label modulo 4 the namespace."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), fx.quantize(F.col("embedding")).alias("fx"), F.col("label").cast("long").alias("tag"), (F.col("label") % 4).alias("namespace_id"),
        (F.lit(EPOCH) + F.col("vec_id") * 3600).alias("created_at"),
    )


def query(r: DataFrame, i: int = 0) -> DataFrame:
    return r.where(F.col("id") == i).select(F.col("fx").alias("q"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its successor: (a, b, va, vb, fa, fb)."""
    r = records(spark, d)
    a = r.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("fx").alias("fa"))
    return a.join(r.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("fx").alias("fb")), "a")


def knn_exact(spark, d):
    r = records(spark, d)
    return search.nearest(r, query(r), 10)


def knn_tag(spark, d):
    r = records(spark, d)
    return search.nearest(r.where("tag = 1"), query(r), 10)


def knn_namespace(spark, d):
    r = records(spark, d)
    return search.nearest(r.where("namespace_id = 2"), query(r, 7), 10)


def knn_batch(spark, d):
    r = records(spark, d)
    return search.batch_nearest(r, _asked(r), 10)


def knn_self_join(spark, d):
    r = records(spark, d)
    found = search.batch_nearest(r, r.select(F.col("id").alias("qid"), F.col("fx").alias("q")), 2)
    return found.where("qid <> id").withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("dist", "id"))).where("r = 1").select("qid", "id", "dist")


def quantize_trunc(spark, d):
    return records(spark, d).select("id", F.explode("fx").alias("x")).groupBy("id").agg(F.sum("x").alias("sum_fx"), F.min("x").alias("min_fx"), F.max("x").alias("max_fx"))


def quantize_round(spark, d):
    r = spark.read.parquet(f"{d}/embeddings.parquet")
    return r.select(F.col("vec_id").alias("id"), F.explode(fx.quantize_round(F.col("embedding"))).alias("x")).groupBy("id").agg(F.sum("x").alias("sum_fx"), F.min("x").alias("min_fx"), F.max("x").alias("max_fx"))


def quantize_cluster(spark, d):
    r = spark.read.parquet(f"{d}/embeddings.parquet")
    return r.select(F.col("vec_id").alias("id"), F.explode(fx.quantize_cluster(F.col("embedding"))).alias("x")).groupBy("id").agg(F.sum("x").alias("sum_fx"))


def dequantize(spark, d):
    return records(spark, d).select("id", F.explode(fx.dequantize(F.col("fx"))).alias("x")).groupBy("id").agg(F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))


def fx_arithmetic(spark, d):
    p = pairs(spark, d).select("a", F.get("fa", F.lit(0)).alias("x"), F.get("fb", F.lit(0)).alias("y"))
    big = F.col("x") * 60000
    return p.select("a", fx.fx_add(F.col("x"), F.col("y")).alias("added"), fx.fx_sub(F.col("x"), F.col("y")).alias("less"), fx.fx_mul(F.col("x"), F.col("y")).alias("times"), fx.saturate(big.cast("long") + big.cast("long")).alias("full"))


def l2_pairs(spark, d):
    return pairs(spark, d).select("a", "b", fx.l2_squared(F.col("fa"), F.col("fb")).alias("dist"))


def l2_float_pairs(spark, d):
    return pairs(spark, d).select("a", "b", F.round(fx.l2_float(F.col("va"), F.col("vb")), 6).alias("dist"))


def dot_pairs(spark, d):
    return pairs(spark, d).select("a", "b", fx.raw_dot(F.col("fa"), F.col("fb")).alias("raw"), fx.fx_dot(F.col("fa"), F.col("fb")).alias("dot"))


def cosine_pairs(spark, d):
    return pairs(spark, d).select("a", "b", F.round(fx.cosine(F.col("fa"), F.col("fb")), 9).alias("cosine"))


def similarity_scores(spark, d):
    s = fx.score(fx.l2_squared(F.col("fa"), F.col("fb")))
    return pairs(spark, d).select("a", "b", F.round(s, 9).alias("score"), F.round(fx.similarity(s), 9).alias("similarity"))


def scalar_quant(spark, d):
    r = records(spark, d).select("id", fx.scalar_quantize(F.col("vec")).alias("codes"))
    back = F.aggregate(fx.scalar_dequantize(F.col("codes")), F.lit(0.0), lambda s, x: s + x)
    return r.select("id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), (F.round(back, 6) + 0.0).alias("back_sum"))


def binarize(spark, d):
    return records(spark, d).select("id", F.get(fx.binarize(F.col("fx")), F.lit(0)).alias("word"), F.bit_count(F.get(fx.binarize(F.col("fx")), F.lit(0))).alias("ones"))


def hamming(spark, d):
    return pairs(spark, d).select("a", "b", fx.hamming(fx.binarize(F.col("fa")), fx.binarize(F.col("fb"))).alias("bits"))


def bq_two_stage(spark, d):
    r = records(spark, d)
    return search.signs_search(r, query(r), 10)


def bq_float(spark, d):
    r = records(spark, d)
    found = search.signs_search_float(r, r.where("id = 0").select(F.col("vec").alias("v")), 10)
    return found.withColumn("distance", F.round("distance", 6))


def _asked(r: DataFrame) -> DataFrame:
    """The query set of the registered searches: every record whose id is divisible by 50."""
    return r.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("fx").alias("q"))


def _recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    lists = lambda t, name: t.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias(name))
    return evaluation.recall_at(lists(found, "found").join(lists(gold, "gold"), "qid"), 10)


def cells_all_equals_exact(spark, d):
    r = records(spark, d)
    index = cells.build(r, 16, probes=16, iterations=5)
    return cells.probe(index, _asked(r), 5)


def _saved(spark, d) -> cells.Cells:
    """The index of all records with default parameters, written to the shared folder and loaded."""
    path = f"{shared_folder(spark)}/mnemospark/cells-{uuid.uuid4().hex}"
    cells.save(cells.build(records(spark, d)), path)
    return cells.load(spark, path)


def cells_probe(spark, d):
    return cells.probe(_saved(spark, d), _asked(records(spark, d)), 10)


def cells_recall(spark, d):
    """Recall at 10 of a saved index as it is probed by default against exact search, one row."""
    r = records(spark, d)
    return _recall(cells_probe(spark, d), search.batch_nearest(r, _asked(r), 10))


def cells_recall_holds(spark, d):
    return cells_recall(spark, d).select((F.col("recall") >= 0.9).alias("holds"), "queries")


def cells_changed(spark, d):
    """An index saved empty, filled before and after it has cells, and with records deleted; all cells are visited."""
    r = records(spark, d)
    path = f"{shared_folder(spark)}/mnemospark/cells-{uuid.uuid4().hex}"
    cells.save(cells.build(r.where("false")), path)
    cells.insert(spark, path, r.where("id % 3 = 0"))
    cells.rebuild(spark, path, iterations=3)
    cells.insert(spark, path, r.where("id % 3 <> 0"))
    cells.delete(spark, path, r.where("id % 7 = 1").select("id"))
    index = cells.load(spark, path)
    return cells.probe(index, _asked(r), 5, probes=len(index.centroids))


def graph_search(spark, d):
    """Layered proximity graphs with default parameters, saved and loaded."""
    r = records(spark, d)
    path = f"{shared_folder(spark)}/mnemospark/graphs-{uuid.uuid4().hex}"
    proximity.save(proximity.build(r), path)
    return proximity.search(proximity.load(spark, path), _asked(r), 10)


def graph_recall(spark, d):
    """Recall at 10 of proximity graphs against exact search, one row."""
    r = records(spark, d)
    return _recall(graph_search(spark, d), search.batch_nearest(r, _asked(r), 10))


def graph_recall_holds(spark, d):
    return graph_recall(spark, d).select((F.col("recall") >= 0.9).alias("holds"), "queries")


def product_codes(spark, d):
    codes, _ = cells.product_codes(records(spark, d), centroids=16, iterations=3)
    return codes


def auto_search(spark, d):
    r = records(spark, d)
    return search.search(r, query(r), 10)


def _hits(spark, d, k: int) -> DataFrame:
    r = records(spark, d)
    return search.nearest(r, query(r), k).join(r.select("id", "created_at", "tag"), "id").select("id", F.col("dist").alias("distance"), "created_at", "tag")


def decay_rerank(spark, d):
    out = search.decay_rerank(_hits(spark, d, search.overfetch(10, decay=True)), NOW, HALF_LIFE, 10)
    return out.select("id", "distance", F.round("factor", 9).alias("factor"))


def decay_zero_halflife(spark, d):
    return search.decay_rerank(_hits(spark, d, 50), NOW, 0, 10).select("id", "distance", "factor")


def _meta(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("props").alias("metadata"))


def meta_filter_exact(spark, d):
    return _meta(spark, d).where(filters.matches(F.col("metadata"), {"k": 7}))


def meta_filter_range(spark, d):
    return _meta(spark, d).where(filters.matches(F.col("metadata"), {"k": {"gte": 20, "lt": 24}})).select("id")


def meta_filter_missing_key(spark, d):
    return _meta(spark, d).agg(F.count_if(filters.matches(F.col("metadata"), {"absent": 1})).alias("absent"), F.count_if(filters.matches(F.col("metadata"), {"k": "7"})).alias("as_text"), F.count_if(filters.matches(F.col("metadata"), {"k": {"eq": 7}})).alias("as_number"))


def knn_with_meta_filter(spark, d):
    """The filter stands before the ranking, so the result has k rows whenever k records pass."""
    r = records(spark, d)
    fine = r.join(_meta(spark, d), "id").where(filters.matches(F.col("metadata"), {"k": {"lt": 50}}))
    return search.nearest(fine, query(r), 10)


def knn_overfetch_filter(spark, d):
    """The filter stands behind a bounded pool of candidates, as services with an index do it."""
    r = records(spark, d)
    pool = search.nearest(r, query(r), search.overfetch(5, filtered=True))
    return pool.join(_meta(spark, d), "id").where(filters.matches(F.col("metadata"), {"k": {"lt": 10}})).orderBy("dist", "id").limit(5).select("id", "dist")


def rank_diff(spark, d):
    r = records(spark, d)
    w = W.orderBy("dist", "id")
    ranked = lambda t: search.nearest(t, query(r), 10).withColumn("rank", F.row_number().over(w))
    return search.rank_difference(ranked(r.where("id % 4 <> 3")), ranked(r.where("tag <> 1")))


def recall_at_k(spark, d):
    """Recall of two-stage search by signs against exact search for one query."""
    r = records(spark, d)
    q = query(r)
    found = search.signs_search(r, q, 10, factor=2, least=20).agg(F.collect_list("id").alias("found"))
    return evaluation.recall_at(found.crossJoin(search.nearest(r, q, 10).agg(F.collect_list("id").alias("gold"))), 10).select(F.round("recall", 6).alias("recall"), F.round("complete", 6).alias("complete"), "queries")


QUERIES = {f.__name__: f for f in (
    knn_exact, knn_tag, knn_namespace, knn_batch, knn_self_join, quantize_trunc, quantize_round, quantize_cluster, dequantize, fx_arithmetic, l2_pairs, l2_float_pairs, dot_pairs, cosine_pairs, similarity_scores, scalar_quant, binarize, hamming,
    bq_two_stage, bq_float, cells_all_equals_exact, cells_probe, cells_recall, cells_recall_holds, cells_changed, graph_search, graph_recall, graph_recall_holds, product_codes, auto_search, decay_rerank, decay_zero_halflife, meta_filter_exact, meta_filter_range, meta_filter_missing_key, knn_with_meta_filter, knn_overfetch_filter, rank_diff, recall_at_k,
)}

_R = f"r AS (SELECT vec_id AS id, embedding AS vec, list_transform(embedding, lambda x: CAST(trunc(x * 65536) AS BIGINT)) AS fx, CAST(label AS BIGINT) AS tag, label % 4 AS namespace_id, {EPOCH} + vec_id * 3600 AS created_at FROM embeddings)"


def _l2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _dot(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) AS BIGINT)"


_P = f"{_R}, p AS (SELECT x.id AS a, y.id AS b, x.vec AS va, y.vec AS vb, x.fx AS fa, y.fx AS fb FROM r x JOIN r y ON y.id = x.id + 1)"
_BITS = "list_transform(fx, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAM = "CAST(list_sum(list_transform(list_zip(fa, fb), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INT)"


def _near(where: str = "true", q: int = 0, k: int = 10) -> str:
    return f"SELECT r.id, {_l2('r.fx', 'q.fx')} AS dist FROM r, (SELECT fx FROM r WHERE id = {q}) q WHERE {where} ORDER BY dist, id LIMIT {k}"


def _scored(where: str = "true", q: int = 0) -> str:
    return f"WITH {_R} SELECT id, dist, dist / 4294967296.0 AS score FROM ({_near(where, q)})"


_BATCH = "SELECT qid, id, dist, CAST(rank AS INT) AS rank FROM (SELECT q.id AS qid, r.id, {l2} AS dist, row_number() OVER (PARTITION BY q.id ORDER BY {l2}, r.id) AS rank FROM r, r q WHERE q.id % 50 = 0 AND {where}) WHERE rank <= {k}"
_HITS = f"h AS (SELECT n.id, n.dist AS distance, r.created_at FROM ({_near(k=50)}) n JOIN r USING (id))"
_DECAY = f"greatest({NOW} - created_at, 0) / {HALF_LIFE}.0"

SQL = {
    "knn_exact": _scored(),
    "knn_tag": _scored("r.tag = 1"),
    "knn_namespace": _scored("r.namespace_id = 2", 7),
    "knn_batch": f"WITH {_R} " + _BATCH.format(l2=_l2("r.fx", "q.fx"), where='true', k=10),
    "knn_self_join": f"WITH {_R}, d AS (SELECT q.id AS qid, r.id, {_l2('r.fx', 'q.fx')} AS dist FROM r, r q WHERE r.id <> q.id) SELECT qid, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM d) WHERE n = 1",
    "quantize_trunc": f"WITH {_R} SELECT id, CAST(sum(x) AS BIGINT) AS sum_fx, CAST(min(x) AS INT) AS min_fx, CAST(max(x) AS INT) AS max_fx FROM (SELECT id, unnest(fx) AS x FROM r) GROUP BY id",
    "quantize_round": "SELECT id, CAST(sum(x) AS BIGINT) AS sum_fx, CAST(min(x) AS INT) AS min_fx, CAST(max(x) AS INT) AS max_fx FROM (SELECT vec_id AS id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 65536) AS BIGINT) AS x FROM embeddings) GROUP BY id",
    "quantize_cluster": "SELECT id, CAST(sum(x) AS BIGINT) AS sum_fx FROM (SELECT vec_id AS id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 65536) AS BIGINT) AS x FROM embeddings) GROUP BY id",
    "dequantize": f"WITH {_R} SELECT id, round(sum(CAST(x / 65536.0 AS DOUBLE)), 6) AS total FROM (SELECT id, unnest(fx) AS x FROM r) GROUP BY id",
    "fx_arithmetic": f"WITH {_P} SELECT a, CAST(fa[1] + fb[1] AS INT) AS added, CAST(fa[1] - fb[1] AS INT) AS less, CAST((fa[1] * fb[1]) >> 16 AS INT) AS times, CAST(greatest(least(fa[1] * 120000, 2147483647), -2147483648) AS INT) AS full FROM p",
    "l2_pairs": f"WITH {_P} SELECT a, b, {_l2('fa', 'fb')} AS dist FROM p",
    "l2_float_pairs": f"WITH {_P} SELECT a, b, round(list_sum(list_transform(list_zip(va, vb), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS dist FROM p",
    "dot_pairs": f"WITH {_P} SELECT a, b, {_dot('fa', 'fb')} AS raw, CAST({_dot('fa', 'fb')} >> 16 AS INT) AS dot FROM p",
    "cosine_pairs": f"WITH {_P} SELECT a, b, round({_dot('fa', 'fb')} / (sqrt(CAST({_dot('fa', 'fa')} AS DOUBLE)) * sqrt(CAST({_dot('fb', 'fb')} AS DOUBLE))), 9) AS cosine FROM p",
    "similarity_scores": f"WITH {_P}, s AS (SELECT a, b, {_l2('fa', 'fb')} / 4294967296.0 AS s FROM p) SELECT a, b, round(s, 9) AS score, round(1 / (1 + s), 9) AS similarity FROM s",
    "scalar_quant": f"WITH {_R}, c AS (SELECT id, list_transform(vec, lambda x: CAST(trunc((CAST(CASE WHEN x > 1 THEN 1 WHEN x < -1 THEN -1 ELSE x END AS FLOAT) + CAST(1 AS FLOAT)) * CAST(127.5 AS FLOAT)) AS INT)) AS codes FROM r) SELECT id, CAST(list_sum(codes) AS BIGINT) AS code_sum, round(list_sum(list_transform(codes, lambda x: x / 127.5 - 1)), 6) + 0.0 AS back_sum FROM c",
    "hamming": f"WITH {_P} SELECT a, b, {_HAM} AS bits FROM p",
    "bq_two_stage": f"WITH {_R}, q AS (SELECT fx AS fb FROM r WHERE id = 0), c AS (SELECT id, fx, fb, {_HAM.replace('fa', 'fx')} AS bits FROM r, q ORDER BY bits, id LIMIT 400) SELECT id, bits, {_l2('fx', 'fb')} AS dist FROM c ORDER BY dist, id LIMIT 10",
    "bq_float": f"WITH {_R}, q AS (SELECT vec AS v FROM r WHERE id = 0), c AS (SELECT id, vec, v, CAST(list_sum(list_transform(list_zip(vec, v), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INT))) AS INT) AS bits FROM r, q ORDER BY bits, id LIMIT 200), s AS (SELECT id, bits, list_sum(list_transform(list_zip(vec, v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS distance FROM c ORDER BY distance, id LIMIT 10) SELECT id, bits, round(distance, 6) AS distance FROM s",
    "cells_all_equals_exact": f"WITH {_R} " + _BATCH.format(l2=_l2("r.fx", "q.fx"), where='true', k=5),
    "cells_changed": f"WITH {_R} " + _BATCH.format(l2=_l2("r.fx", "q.fx"), where="r.id % 7 <> 1", k=5),
    "cells_recall_holds": "SELECT true AS holds, count(*) AS queries FROM embeddings WHERE vec_id % 50 = 0",
    "graph_recall_holds": "SELECT true AS holds, count(*) AS queries FROM embeddings WHERE vec_id % 50 = 0",
    "auto_search": f"WITH {_R} {_near()}",
    "decay_rerank": f"WITH {_R}, {_HITS} SELECT id, distance, round(pow(0.5, {_DECAY}), 9) AS factor FROM h ORDER BY distance / greatest(pow(0.5, {_DECAY}), 1e-9), id LIMIT 10",
    "decay_zero_halflife": f"WITH {_R}, {_HITS} SELECT id, distance, CAST(1.0 AS DOUBLE) AS factor FROM h ORDER BY distance, id LIMIT 10",
    "meta_filter_exact": "SELECT event_id AS id, props AS metadata FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "meta_filter_range": "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 24",
    "meta_filter_missing_key": "SELECT CAST(0 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS as_text, count(*) AS as_number FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 7",
    "knn_with_meta_filter": f"WITH {_R}, m AS (SELECT event_id AS mid FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) < 50), n AS (SELECT r.id, {_l2('r.fx', 'q.fx')} AS dist FROM r JOIN m ON r.id = m.mid, (SELECT fx FROM r WHERE id = 0) q ORDER BY dist, id LIMIT 10) SELECT id, dist, dist / 4294967296.0 AS score FROM n",
    "knn_overfetch_filter": f"WITH {_R}, n AS ({_near(k=100)}) SELECT n.id, dist FROM n JOIN events e ON e.event_id = n.id WHERE CAST(json_extract(props, '$.k') AS DOUBLE) < 10 ORDER BY dist, id LIMIT 5",
    "rank_diff": f"WITH {_R}, a AS (SELECT id, CAST(row_number() OVER (ORDER BY dist, id) AS INT) AS rank_before FROM ({_near('r.id % 4 <> 3')})), b AS (SELECT id, CAST(row_number() OVER (ORDER BY dist, id) AS INT) AS rank_after FROM ({_near('r.tag <> 1')})) SELECT id, rank_before, rank_after, CASE WHEN rank_before IS NULL THEN 'entered' WHEN rank_after IS NULL THEN 'left' WHEN rank_before <> rank_after THEN 'shifted' ELSE 'same' END AS change FROM a FULL JOIN b USING (id)",
    "recall_at_k": f"WITH {_R}, q AS (SELECT fx AS fb FROM r WHERE id = 0), c AS (SELECT id, fx, fb, {_HAM.replace('fa', 'fx')} AS bits FROM r, q ORDER BY bits, id LIMIT 20), f AS (SELECT id FROM (SELECT id, {_l2('fx', 'fb')} AS dist FROM c ORDER BY dist, id LIMIT 10)), g AS (SELECT id FROM ({_near()})) SELECT round(count(*) / 10.0, 6) AS recall, CAST(CASE WHEN count(*) = 10 THEN 1 ELSE 0 END AS DOUBLE) AS complete, CAST(1 AS BIGINT) AS queries FROM f JOIN g USING (id)",
    "binarize": f"WITH {_R}, b AS (SELECT id, {_BITS} AS bits FROM r), u AS (SELECT id, generate_subscripts(bits, 1) - 1 AS i, unnest(bits) AS bit FROM b) SELECT id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS word, ones FROM (SELECT id, sum(CAST(bit AS HUGEINT) * (CAST(1 AS HUGEINT) << i)) AS s, CAST(sum(bit) AS INT) AS ones FROM u WHERE i < 64 GROUP BY id)",
}
