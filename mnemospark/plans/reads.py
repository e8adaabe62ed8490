"""Registered queries for whole reads: searches with options, the past, collections, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, log, service
from .history import _LOG, _fold, event_log, talk_graph
from .text import QUESTION, _SCORE, corpus
from .vectors import _R, HALF_LIFE, NOW, _l2, _meta, query, records


def _all(spark, d):
    """Records with flags (every ninth deleted softly) and the metadata of the events of the same number."""
    return records(spark, d).withColumn("flags", F.when(F.col("id") % 9 == 4, 1).otherwise(0)).join(_meta(spark, d), "id", "left")


def search_composite(spark, d):
    """Namespace, tag, metadata and decay together."""
    r = _all(spark, d)
    return service.find(r, query(r, 3), 8, namespace=1, metadata={"k": {"gte": 10}}, now=NOW, half_life=HALF_LIFE).select("id", "distance", "position")


def search_reranked(spark, d):
    r = _all(spark, d)
    return service.find(r, query(r, 3), 5, docs=corpus(spark, d), text=QUESTION).select("id", "distance", "position")


def memory_search(spark, d):
    """Hits with their metadata, those without dropped by the filter behind the pool."""
    r = _all(spark, d)
    return service.find(r, query(r, 3), 5, metadata={"k": {"lt": 60}}, pool=True).select("id", "distance", "metadata", "position")


def _vector_log(spark, d):
    """The event log with the vectors of the records that have one."""
    v = records(spark, d).select(F.col("id").alias("record_id"), F.col("fx").alias("own"))
    return event_log(spark, d).join(v, "record_id", "left").withColumn("fx", F.when(F.col("event_type") == "InsertRecord", F.col("own"))).drop("own")


def replay_query(spark, d):
    """Search in the state of an earlier log index."""
    l = _vector_log(spark, d)
    return service.find_as_of(l.where("fx is not null or event_type <> 'InsertRecord'"), query(records(spark, d)), 5, index=900, namespace=2).select("id", "distance", "position")


def event_difference(spark, d):
    l = event_log(spark, d)
    return service.event_difference(l.where("log_index <= 500"), l.where("log_index <= 800")).groupBy("event_type").agg(F.count("*").alias("n"))


def point_lookups(spark, d):
    """One record, node, edge and meta row by key."""
    n, e = talk_graph(spark, d)
    rec = log.fold(event_log(spark, d)).records.where("id = 12").select(F.lit("record").alias("what"), F.col("id").cast("string").alias("key"))
    return rec.unionByName(n.where("id = 3001").select(F.lit("node").alias("what"), F.col("id").cast("string").alias("key"))).unionByName(e.where("src = 3000 and dst = 3001").select(F.lit("edge").alias("what"), F.col("id").cast("string").alias("key")))


def nodes_in_namespace(spark, d):
    n, _ = talk_graph(spark, d)
    return n.where("namespace_id = 1").select("id", "kind", "record_id")


def collection_resolve(spark, d):
    names = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 4).cast("int").alias("namespace_id"))
    at = service.resolve_collection(names, names.orderBy("name").first()["name"])
    return records(spark, d).where(F.col("namespace_id") == at).agg(F.count("*").alias("n"))


def entity_extraction(spark, d):
    found = service.extract(spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), service.dictionary_matcher({"the": "article", "of": "preposition", "und": "conjunction"}))
    return found.groupBy("name", "kind").agg(F.count("*").alias("n"))


def operation_receipts(spark, d):
    e = event_log(spark, d)
    return service.operation_receipt(e.select(F.col("log_index").alias("n"), F.col("event_type").alias("operation"), F.lit("g").alias("graph"), F.lit("a").alias("before"), F.lit("b").alias("after"), F.array(F.lit("x"), F.lit("y")).alias("fragments")))


def contradictions_open(spark, d):
    from ..operators import graph

    _, e = talk_graph(spark, d)
    marked = e.withColumn("kind", F.when(F.col("dst") % 10 == 3, 8).otherwise(F.col("kind")))
    return graph.open_contradictions(marked).agg(F.count("*").alias("n"))


def bm25_postings_size(spark, d):
    return bm25.postings(corpus(spark, d)).agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


QUERIES = {f.__name__: f for f in (search_composite, search_reranked, memory_search, replay_query, event_difference, point_lookups, nodes_in_namespace, collection_resolve, entity_extraction, operation_receipts, contradictions_open, bm25_postings_size)}

_ALL = f"{_R}, a AS (SELECT r.*, CASE WHEN r.id % 9 = 4 THEN 1 ELSE 0 END AS flags, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, props AS metadata FROM r LEFT JOIN events ON event_id = r.id), q AS (SELECT fx FROM r WHERE id = 3)"
_AGE = f"greatest({NOW} - created_at, 0) / {HALF_LIFE}.0"
_TALK_N = "n AS (SELECT DISTINCT conv_id * 1000 + turn + 1 AS id, 6 AS kind, conv_id * 7 % 500 AS record_id, conv_id % 4 AS ns FROM conversations UNION ALL SELECT DISTINCT conv_id * 1000, 5, NULL, conv_id % 4 FROM conversations)"

SQL = {
    "search_composite": f"WITH {_ALL}, p AS (SELECT a.id, {_l2('a.fx', 'q.fx')} AS distance, created_at FROM a, q WHERE flags = 0 AND namespace_id = 1 AND k >= 10 ORDER BY distance, id LIMIT 50) SELECT id, distance, CAST(row_number() OVER (ORDER BY distance / greatest(pow(0.5, {_AGE}), 1e-9), id) AS INT) AS position FROM p QUALIFY position <= 8",
    "search_reranked": f"WITH {_ALL}, {_SCORE.replace(', q AS', ', qq AS').replace('FROM q)', 'FROM qq)').replace('JOIN q USING', 'JOIN qq USING')}, p AS (SELECT a.id, {_l2('a.fx', 'q.fx')} AS distance FROM a, q WHERE flags = 0 ORDER BY distance, a.id LIMIT 100), z AS (SELECT p.id, distance, coalesce(bm25, 0.0) AS bm25, row_number() OVER (ORDER BY distance, p.id) AS rank FROM p LEFT JOIN sc ON sc.id = p.id), m AS (SELECT min(distance) AS lo, max(distance) AS hi, min(bm25) AS c, max(bm25) AS e FROM z) SELECT id, distance, CAST(row_number() OVER (ORDER BY 0.5 * (1 - (CAST(distance AS DOUBLE) - lo) / (hi - lo)) + 0.5 * (bm25 - c) / (e - c) DESC, rank) AS INT) AS position FROM z, m QUALIFY position <= 5",
    "memory_search": f"WITH {_ALL}, p AS (SELECT a.id, {_l2('a.fx', 'q.fx')} AS distance, metadata, k FROM a, q WHERE flags = 0 ORDER BY distance, id LIMIT 100) SELECT id, distance, metadata, CAST(row_number() OVER (ORDER BY distance, id) AS INT) AS position FROM p WHERE k < 60 QUALIFY position <= 5",
    "replay_query": f"WITH {_R}, {_LOG}, {_fold('log_index <= 900')}, p AS (SELECT rec.id, {_l2('r.fx', 'q.fx')} AS distance FROM rec JOIN r USING (id), (SELECT fx FROM r WHERE id = 0) q WHERE rec.namespace_id = 2 AND flags = 0 ORDER BY distance, rec.id LIMIT 5) SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, id) AS INT) AS position FROM p",
    "event_difference": f"WITH {_LOG} SELECT event_type, count(*) AS n FROM l WHERE log_index BETWEEN 501 AND 800 GROUP BY event_type",
    "point_lookups": f"WITH {_LOG}, {_fold()}, {_TALK_N} SELECT 'record' AS what, CAST(id AS VARCHAR) AS key FROM rec WHERE id = 12 UNION ALL SELECT 'node', CAST(id AS VARCHAR) FROM n WHERE id = 3001 UNION ALL SELECT 'edge', CAST(3000 * 10000 + id % 10000 * 10 + 6 AS VARCHAR) FROM n WHERE id = 3001",
    "nodes_in_namespace": f"WITH {_TALK_N} SELECT id, kind, record_id FROM n WHERE ns = 1",
    "collection_resolve": "SELECT count(*) AS n FROM embeddings WHERE label % 4 = (SELECT r_regionkey % 4 FROM region ORDER BY r_name LIMIT 1)",
    "entity_extraction": "SELECT name, kind, count(*) AS n FROM conversations, (VALUES ('the', 'article'), ('of', 'preposition'), ('und', 'conjunction')) v(name, kind) WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || name || '([^\\p{L}\\p{N}_]|$)') GROUP BY name, kind",
    "operation_receipts": f"WITH {_LOG} SELECT log_index AS n, sha256(sha256(event_type) || chr(31) || sha256('g') || chr(31) || 'a' || chr(31) || 'b' || chr(31) || 'x,y') AS receipt FROM l",
    "contradictions_open": f"WITH {_TALK_N}, e AS (SELECT a.id AS dst FROM n a JOIN n b ON b.id = a.id - 1 AND b.kind = 6 AND a.kind = 6 UNION ALL SELECT id FROM n WHERE kind = 6) SELECT count(*) AS n FROM e WHERE dst % 10 = 3",
    "bm25_postings_size": f"WITH {_SCORE} SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM pos",
}
