"""Registered queries over the event log, proofs and the conversation and order graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, evaluation, graph, log, proofs, search
from .vectors import _P, _R, _dot, _l2, query, records

#: Indexes at which the past is read, as shares of the table's events.
PAST = 5_000


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a log.  Views insert records, numbered in log order; signups create nodes for records; clicks
    update metadata, errors delete softly, each of the record whose number is the event's number modulo 1000; purchases
    set meta rows, and those of every hundredth event drop a namespace or delete a record for good."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("log_index"), F.unix_timestamp("ts").alias("ts"), "user_id", "event_type", "props")
    made = log.number(e.where("event_type = 'view'").select("log_index"), "log_index", "record_id")
    e = e.join(made, "log_index", "left")
    target = F.col("log_index") % 1000
    t = F.col("event_type")
    odd = F.col("log_index") % 100 == 0
    kind = F.when(t == "view", "InsertRecord").when(t == "signup", "CreateNode").when(t == "click", "UpdateMetadata").when(t == "error", "SoftDelete").when(odd & (F.col("log_index") % 200 == 0), "DropNamespace").when(odd, "HardDelete").otherwise("SetMeta")
    e = e.withColumn("kind_", kind)
    ns = F.when(F.col("kind_") == "InsertRecord", F.col("user_id") % 8).when(F.col("kind_") == "DropNamespace", F.col("user_id") % 6).otherwise(0)
    null = lambda k: F.lit(None).cast(k)
    return e.select(
        "log_index", "ts", ns.cast("int").alias("namespace_id"), F.col("kind_").alias("event_type"),
        F.when(F.col("kind_") == "InsertRecord", F.col("record_id")).when(F.col("kind_").isin("UpdateMetadata", "SoftDelete", "HardDelete", "CreateNode"), target).alias("record_id"),
        F.when(F.col("kind_") == "CreateNode", F.col("log_index")).alias("node_id"), null("long").alias("edge_id"), F.when(F.col("kind_") == "CreateNode", 0).alias("kind"), null("long").alias("src"), null("long").alias("dst"), null("array<int>").alias("fx"),
        F.when(F.col("kind_").isin("InsertRecord", "UpdateMetadata"), F.col("props")).alias("metadata"), F.when(F.col("kind_") == "InsertRecord", F.col("user_id") % 5).alias("tag"),
        F.when(F.col("kind_") == "SetMeta", F.concat(F.lit("user:"), (F.col("user_id") % 50).cast("string"))).alias("key"), F.when(F.col("kind_") == "SetMeta", F.col("props")).alias("value"), null("string").alias("key_id"),
        F.concat(F.lit("q"), (F.col("log_index") % 4000).cast("string")).alias("request_id"),
    )


def log_fold(spark, d):
    return log.fold(event_log(spark, d)).records.select("id", "namespace_id", "tag", "flags", "metadata")


def log_nodes(spark, d):
    return log.fold(event_log(spark, d)).nodes


def log_meta(spark, d):
    return log.fold(event_log(spark, d)).meta


def as_of_index(spark, d):
    past = log.as_of_index(event_log(spark, d), 500)
    return log.fold(past).records.groupBy("namespace_id").agg(F.count("*").alias("live"), F.count_if(search.searchable(F.col("flags"))).alias("searchable"))


def as_of_time(spark, d):
    l = event_log(spark, d)
    middle = spark.read.parquet(f"{d}/events.parquet").agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b")).first()
    return log.fold(log.as_of_time(l, (middle["a"] + middle["b"]) // 2)).records.groupBy("namespace_id").agg(F.count("*").alias("live"))


def timeline_range(spark, d):
    lo, hi = _span(spark, d)
    return log.timeline(event_log(spark, d), lo, hi).select("log_index", "ts", "event_type")


def _span(spark, d) -> tuple[int, int]:
    r = spark.read.parquet(f"{d}/events.parquet").agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b")).first()
    return r["a"] + (r["b"] - r["a"]) // 4, r["a"] + (r["b"] - r["a"]) // 2


def event_counts(spark, d):
    return log.event_counts(event_log(spark, d))


def request_dedup(spark, d):
    return log.dedup_requests(event_log(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.max("log_index").alias("last"))


def state_diff(spark, d):
    return log.difference(event_log(spark, d), 300, 900)


def soft_vs_hard_delete(spark, d):
    l = event_log(spark, d)
    r = log.fold(l).records
    total = l.agg(F.count_if(F.col("event_type") == "InsertRecord").alias("inserted"))
    return r.agg(F.count("*").alias("live"), F.count_if(F.col("flags") == log.SOFT).alias("soft")).crossJoin(total)


def drop_namespace(spark, d):
    l = event_log(spark, d)
    dropped = l.where("event_type = 'DropNamespace' and namespace_id <> 0").select("namespace_id").distinct()
    return dropped.join(log.fold(l).records.groupBy("namespace_id").agg(F.count("*").alias("later")), "namespace_id", "left").select("namespace_id", F.coalesce("later", F.lit(0)).alias("later"))


def insert_rejects(spark, d):
    l = event_log(spark, d).withColumn("namespace_id", F.when(F.col("log_index") % 500 == 7, 2000).otherwise(F.col("namespace_id")))
    return log.rejects(l, dim=4)


def pool_stats(spark, d):
    return log.pool_stats(log.fold(event_log(spark, d)).records, 2200)


def gauges(spark, d):
    """Live rows, capacity and fill of the state's tables."""
    return log.gauges(log.fold(event_log(spark, d)), {"records": 200_000, "nodes": 50_000, "edges": 0})


def shard_routing(spark, d):
    return log.shard_routing(event_log(spark, d).select("namespace_id"), 3)


def talk_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as chunk nodes that follow each other, under a document node each."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn")
    turn = F.col("conv_id") * 1000 + F.col("turn") + 1
    chunks = t.select(turn.alias("id"), F.lit(6).alias("kind"), (F.col("conv_id") * 7 % 500).alias("record_id"), (F.col("conv_id") % 4).cast("int").alias("namespace_id")).dropDuplicates(["id"])
    docs = t.select((F.col("conv_id") * 1000).alias("id"), F.lit(5).alias("kind"), F.lit(None).cast("long").alias("record_id"), (F.col("conv_id") % 4).cast("int").alias("namespace_id")).distinct()
    nodes = docs.unionByName(chunks)
    follows = chunks.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1).alias("kind")).where("src % 1000 > 0").join(chunks.select(F.col("id").alias("src")), "src", "left_semi")
    parents = chunks.select((F.col("id") - F.col("id") % 1000).alias("src"), F.col("id").alias("dst"), F.lit(6).alias("kind"))
    edges = follows.select("src", "dst", "kind").unionByName(parents)
    return nodes, edges.select((F.col("src") * 10_000 + F.col("dst") % 10_000 * 10 + F.col("kind")).alias("id"), "kind", "src", "dst")


def order_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and their orders: ParentOf."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("o"), F.col("o_custkey").cast("long").alias("c"))
    nodes = c.select((F.col("k") * 2).alias("id"), F.lit(3).alias("kind"), F.lit(None).cast("long").alias("record_id"), F.lit(0).alias("namespace_id")).unionByName(o.select((F.col("o") * 2 + 1).alias("id"), F.lit(5).alias("kind"), F.lit(None).cast("long").alias("record_id"), F.lit(0).alias("namespace_id")))
    return nodes, o.select(F.col("o").alias("id"), F.lit(6).alias("kind"), (F.col("c") * 2).alias("src"), (F.col("o") * 2 + 1).alias("dst"))


def build_nodes_edges(spark, d):
    n, e = order_graph(spark, d)
    return n.groupBy("kind").agg(F.count("*").alias("nodes")).join(graph.valid_edges(e, n).agg(F.count("*").alias("edges")))


def node_edges(spark, d):
    n, e = order_graph(spark, d)
    return e.join(n.where("kind = 3").select(F.col("id").alias("src")), "src", "left_semi").groupBy("src").agg(F.count("*").alias("degree"))


def subgraph_bfs(spark, d):
    n, e = talk_graph(spark, d)
    near, _ = graph.subgraph(n, e, spark.range(0, 30).select((F.col("id") * 1000 + 1).alias("id")), 3)
    return near


def subgraph_edges(spark, d):
    n, e = talk_graph(spark, d)
    _, inner = graph.subgraph(n, e, spark.range(0, 30).select((F.col("id") * 1000).alias("id")), 2)
    return inner


def walk(spark, d):
    n, e = talk_graph(spark, d)
    return graph.walk(n, e, spark.range(0, 10).select((F.col("id") * 1000 + 1).alias("id")), 5).groupBy("dist").agg(F.count("*").alias("nodes"))


def expand(spark, d):
    n, e = talk_graph(spark, d)
    return graph.expand(n, e, spark.range(0, 20).select((F.col("id") * 1000).alias("id")), 1)


def cascade_delete(spark, d):
    n, e = talk_graph(spark, d)
    nodes, edges = graph.delete_nodes(n, e, n.where("kind = 5 and id % 3000 = 0").select("id"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def graphrag(spark, d):
    """The subgraph around the ten records nearest to one."""
    r = records(spark, d)
    n, e = talk_graph(spark, d)
    near, _ = graph.search_graph(search.nearest(r, query(r), 10), n, e, 2)
    return near


def contradict_pairs(spark, d):
    r = records(spark, d)
    p = r.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return graph.contradictions(p, r, 0.3).select("a", "b", F.round("similarity", 9).alias("similarity"))


def consolidate(spark, d):
    r = records(spark, d)
    asked = r.select(F.col("id").alias("n"), (F.col("id") * 2).alias("old_record"), F.col("fx").alias("new_fx"), F.col("namespace_id").cast("int"))
    return graph.consolidate(asked, 1000, 2000, 3000, 5000).select("log_index", "event_type", "record_id", "node_id", "edge_id", "kind", "src", "dst")


def memory_upsert(spark, d):
    r = records(spark, d)
    asked = r.select(F.col("id").alias("n"), "fx", F.lit("{}").alias("metadata"), F.when(F.col("id") % 2 == 0, F.col("id") + 90_000).alias("document_node"), F.col("namespace_id").cast("int"))
    return graph.upsert(asked, 1000, 2000, 3000, 5000).select("log_index", "event_type", "record_id", "node_id", "edge_id", "src", "dst", "key")


def node_rejects(spark, d):
    return log.node_rejects(event_log(spark, d))


def shred_keys(spark, d):
    """The log with every third insert encrypted under one of 40 keys, of which every fourth is shredded afterwards."""
    l = event_log(spark, d)
    hidden = (F.col("event_type") == "InsertRecord") & (F.col("log_index") % 3 == 0)
    l = l.withColumn("key_id", F.when(hidden, F.concat(F.lit("k"), (F.col("log_index") % 40).cast("string")))).withColumn("event_type", F.when(hidden, "InsertEncrypted").otherwise(F.col("event_type")))
    last = l.agg(F.max("log_index")).first()[0] or 0
    keys = spark.range(0, 40, 4).select((F.col("id") + last + 1).alias("log_index"), F.lit(0).cast("long").alias("ts"), F.lit(0).alias("namespace_id"), F.lit("ShredKey").alias("event_type"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key_id"))
    return log.fold(l.unionByName(keys, allowMissingColumns=True)).records.select("id", "flags", "metadata")


def insert_receipts(spark, d):
    v = records(spark, d).select(F.col("id").alias("record_id"), F.col("fx").alias("own"))
    l = event_log(spark, d).join(v, "record_id", "left").withColumn("fx", F.col("own"))
    return proofs.insert_receipts(l).select("record_id", "metadata_hash", "receipt_hash")


def insert_receipts_broken(spark, d):
    """Receipts of which those of every hundredth record have been changed."""
    r = proofs.insert_receipts(event_log(spark, d))
    return proofs.broken_insert_receipts(r.withColumn("namespace_id", F.when(F.col("record_id") % 100 == 5, 9).otherwise(F.col("namespace_id")))).select("record_id")


def citation_rates(spark, d):
    """Answers that cite two records each, some of which don't exist or have no node."""
    n, _ = talk_graph(spark, d)
    r = records(spark, d).select("id")
    answers = r.select(F.col("id").alias("qid"), F.array(F.col("id"), F.col("id") * 2).alias("cited"))
    return evaluation.citations(answers, r, n).select(F.round("existence", 6).alias("existence"), F.round("provenance", 6).alias("provenance"), "citations")


def community_members(spark, d):
    """The nearest communities with their first twenty members."""
    a, n = _communities(spark, d)
    q = records(spark, d).where("id = 0").select(F.col("vec").alias("q"))
    return community.search(community.centroids(a, n, records(spark, d)), q, 5, a).select("community", "members", "first")


def community_scope(spark, d):
    """Components of one namespace's nodes, as communities are found inside them."""
    n, e = talk_graph(spark, d)
    found = community.detect(n, e, namespace=2)
    return found.agg(F.count("*").alias("nodes"), F.count_if(F.floor(F.col("community") / 1000) != F.floor(F.col("id") / 1000)).alias("astray"))


def resolve_entities(spark, d):
    c = spark.read.parquet(f"{d}/nation.parquet")
    e = c.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    rel = c.select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("nowhere")).otherwise(F.reverse(F.reverse("n_name"))).alias("target"), F.lit("is").alias("label"))
    edges, counts = graph.resolve_names(rel, e)
    return edges.agg(F.sum("src").alias("src"), F.sum("dst").alias("dst")).crossJoin(counts)


def community_detect(spark, d):
    n, e = talk_graph(spark, d)
    return community.detect(n, e)


def community_components(spark, d):
    n, e = talk_graph(spark, d)
    return community.components(n, e)


def _communities(spark, d) -> tuple[DataFrame, DataFrame]:
    """Components of the talk graph as communities, which SQL can tell too, and the nodes."""
    n, e = talk_graph(spark, d)
    return community.components(n, e).select("id", F.col("component").alias("community")), n


def community_centroid(spark, d):
    a, n = _communities(spark, d)
    c = community.centroids(a, n, records(spark, d))
    return c.select("community", "members", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def community_search(spark, d):
    a, n = _communities(spark, d)
    store = community.centroids(a, n, records(spark, d))
    q = records(spark, d).where("id = 0").select(F.col("vec").alias("q"))
    return community.search(store, q, 5).select("community", F.round("similarity", 6).alias("similarity"), "members")


def community_overview(spark, d):
    a, _ = _communities(spark, d)
    return community.overview(a)


def community_receipt(spark, d):
    a, _ = _communities(spark, d)
    return community.receipt(a)


def vector_merkle(spark, d):
    return records(spark, d).select("id", proofs.merkle_root(F.col("fx")).alias("root"))


def state_hash(spark, d):
    return proofs.state_hash(log.fold(event_log(spark, d)).records, "id", ["namespace_id", "tag", "flags", "metadata"])


def log_chain(spark, d):
    l = event_log(spark, d).withColumn("i", F.col("log_index")).withColumn("digest", proofs.row_digest("log_index", "ts", "event_type", "record_id", "key"))
    return proofs.heads(proofs.chain(l, F.floor(F.col("i") / 1000)))


def log_chain_verify(spark, d):
    """A chain whose log was changed afterwards in two places."""
    l = event_log(spark, d).withColumn("i", F.col("log_index")).withColumn("digest", proofs.row_digest("log_index", "event_type"))
    segment = F.floor(F.col("i") / 1000)
    changed = l.withColumn("digest", F.when(F.col("i").isin(123, 777), F.lit("x")).otherwise(F.col("digest")))
    return proofs.broken(proofs.chain(l, segment), changed, segment)


def receipt_chain_verify(spark, d):
    """Receipts of consecutive answers, one of them changed."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("i"), F.sha2("text", 256).alias("digest"))
    first = proofs.chain(b, F.lit(0)).select("i", "prev_hash", "chain_hash")
    fields = [F.sha2(F.concat(F.lit(k), F.col("i").cast("string")), 256).alias(k) for k in ("query_hash", "evidence_hash", "answer_hash")]
    base = first.select("i", F.lit("0001,0002").alias("visited"), F.lit("1-4").alias("ranges"), *fields)
    return proofs.verify_receipts(_linked(base).withColumn("answer_hash", F.when(F.col("i") == 17, F.lit("x")).otherwise(F.col("answer_hash"))))


def _linked(base: DataFrame) -> DataFrame:
    """Receipts chained in order of i; a bounded table, made in one task."""
    import hashlib

    def run(pdf):
        previous, out = proofs.GENESIS, []
        for r in pdf.sort_values("i").to_dict("records"):
            h = hashlib.sha256(proofs.SEPARATOR.join([previous, r["query_hash"], r["visited"], r["ranges"], r["evidence_hash"], r["answer_hash"]]).encode()).hexdigest()
            out.append(r | {"prev_hash": previous, "receipt_hash": h})
            previous = h
        import pandas as pd

        return pd.DataFrame(out)

    return base.groupBy("visited").applyInPandas(run, "i long, visited string, ranges string, query_hash string, evidence_hash string, answer_hash string, prev_hash string, receipt_hash string")


def recall_receipt(spark, d):
    from pyspark.sql import Window as W

    r = records(spark, d)
    found = search.nearest(r, query(r), 5).withColumn("rank", F.row_number().over(W.orderBy("dist", "id")))
    return proofs.recall_receipt(found, "s", "h", 100, 64, 5)


QUERIES = {f.__name__: f for f in (
    log_fold, log_nodes, log_meta, as_of_index, as_of_time, timeline_range, event_counts, request_dedup, state_diff, soft_vs_hard_delete, drop_namespace, insert_rejects, pool_stats, gauges, shard_routing, build_nodes_edges, node_edges, subgraph_bfs,
    subgraph_edges, walk, expand, cascade_delete, graphrag, contradict_pairs, consolidate, memory_upsert, node_rejects, shred_keys, insert_receipts, insert_receipts_broken, citation_rates, community_members, community_scope, resolve_entities, community_detect, community_components, community_centroid, community_search, community_overview, community_receipt,
    vector_merkle, state_hash, log_chain, log_chain_verify, receipt_chain_verify, recall_receipt,
)}

_LOG = """ev AS (SELECT event_id AS log_index, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type AS t, props FROM events),
nu AS (SELECT log_index, row_number() OVER (ORDER BY log_index) - 1 AS rid FROM ev WHERE t = 'view'),
k AS (SELECT ev.*, rid, CASE WHEN t = 'view' THEN 'InsertRecord' WHEN t = 'signup' THEN 'CreateNode' WHEN t = 'click' THEN 'UpdateMetadata' WHEN t = 'error' THEN 'SoftDelete' WHEN log_index % 200 = 0 THEN 'DropNamespace' WHEN log_index % 100 = 0 THEN 'HardDelete' ELSE 'SetMeta' END AS kd FROM ev LEFT JOIN nu USING (log_index)),
l AS (SELECT log_index, ts, CAST(CASE WHEN kd = 'InsertRecord' THEN user_id % 8 WHEN kd = 'DropNamespace' THEN user_id % 6 ELSE 0 END AS INT) AS ns, kd AS event_type, CASE WHEN kd = 'InsertRecord' THEN rid WHEN kd IN ('UpdateMetadata', 'SoftDelete', 'HardDelete', 'CreateNode') THEN log_index % 1000 END AS rec, props, user_id % 5 AS tag, 'user:' || (user_id % 50) AS key, 'q' || (log_index % 4000) AS request_id FROM k)"""


def _fold(upto: str = "true", suffix: str = "") -> str:
    x = suffix
    return f"""ll{x} AS (SELECT * FROM l WHERE {upto}), ins{x} AS (SELECT rec AS id, ns, log_index AS born, tag, props FROM ll{x} WHERE event_type = 'InsertRecord'),
lt{x} AS (SELECT rec AS id, max(log_index) FILTER (event_type = 'SoftDelete') AS s, max(log_index) FILTER (event_type = 'HardDelete') AS h, max(log_index) FILTER (event_type = 'UpdateMetadata') AS u, arg_max(props, log_index) FILTER (event_type = 'UpdateMetadata') AS up FROM ll{x} WHERE rec IS NOT NULL GROUP BY rec),
dp{x} AS (SELECT ns, max(log_index) AS dr FROM ll{x} WHERE event_type = 'DropNamespace' AND ns <> 0 GROUP BY ns),
rec{x} AS (SELECT id, ins.ns AS namespace_id, tag, CASE WHEN s > born THEN 1 ELSE 0 END AS flags, CASE WHEN u > born THEN up ELSE props END AS metadata FROM ins{x} ins LEFT JOIN lt{x} USING (id) LEFT JOIN dp{x} dp ON dp.ns = ins.ns WHERE NOT coalesce(h > born, false) AND NOT coalesce(dr > born, false)),
nod{x} AS (SELECT log_index AS id, 0 AS kind, rec AS record_id, ns AS namespace_id FROM ll{x} WHERE event_type = 'CreateNode'),
met{x} AS (SELECT key, arg_max(props, log_index) AS value FROM ll{x} WHERE event_type = 'SetMeta' GROUP BY key)"""


_TALK = """ch AS (SELECT DISTINCT conv_id * 1000 + turn + 1 AS id, 6 AS kind, conv_id * 7 % 500 AS record_id, conv_id % 4 AS ns FROM conversations), dc AS (SELECT DISTINCT conv_id * 1000 AS id, 5 AS kind, CAST(NULL AS BIGINT) AS record_id, conv_id % 4 AS ns FROM conversations),
n AS (SELECT * FROM ch UNION ALL SELECT * FROM dc),
e AS (SELECT a.id - 1 AS src, a.id AS dst, 1 AS kind FROM ch a JOIN ch b ON b.id = a.id - 1 WHERE (a.id - 1) % 1000 > 0 UNION ALL SELECT id - id % 1000, id, 6 FROM ch)"""


def _reach(seeds: str, depth: int) -> str:
    out = [f"w0 AS (SELECT DISTINCT id FROM n WHERE id IN ({seeds}))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM w{j}" for j in range(k))
        out.append(f"w{k} AS (SELECT DISTINCT e.dst AS id FROM w{k - 1} JOIN e ON e.src = w{k - 1}.id WHERE e.dst IN (SELECT id FROM n) AND e.dst NOT IN ({seen}))")
    return ", ".join([*out, "near AS (" + " UNION ALL ".join(f"SELECT id, {k} AS dist FROM w{k}" for k in range(depth + 1)) + ")"])


_COMM = f"{_TALK}, cm AS (SELECT id, id - id % 1000 AS community FROM n)"
_MEAN = f"{_COMM}, vx AS (SELECT community, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM cm JOIN n USING (id) JOIN embeddings ON vec_id = record_id), mn AS (SELECT community, j, avg(CAST(x AS DOUBLE)) AS m FROM vx GROUP BY ALL), sz AS (SELECT community, count(*) AS members FROM cm GROUP BY community)"

SQL = {
    "log_fold": f"WITH {_LOG}, {_fold()} SELECT * FROM rec",
    "log_nodes": f"WITH {_LOG}, {_fold()} SELECT * FROM nod",
    "log_meta": f"WITH {_LOG}, {_fold()} SELECT * FROM met",
    "as_of_index": f"WITH {_LOG}, {_fold('log_index <= 500')} SELECT namespace_id, count(*) AS live, count(*) FILTER (flags = 0) AS searchable FROM rec GROUP BY namespace_id",
    "as_of_time": f"WITH {_LOG}, {_fold('log_index <= (SELECT max(log_index) FROM l WHERE ts <= (SELECT (min(ts) + max(ts)) // 2 FROM l))')} SELECT namespace_id, count(*) AS live FROM rec GROUP BY namespace_id",
    "timeline_range": f"WITH {_LOG}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM l) SELECT log_index, ts, event_type FROM l, b WHERE ts BETWEEN a + (z - a) // 4 AND a + (z - a) // 2",
    "event_counts": f"WITH {_LOG} SELECT event_type, count(*) AS n FROM l GROUP BY event_type",
    "request_dedup": f"WITH {_LOG} SELECT event_type, count(*) AS n, max(log_index) AS last FROM l WHERE log_index IN (SELECT min(log_index) FROM l GROUP BY request_id) GROUP BY event_type",
    "state_diff": f"WITH {_LOG}, {_fold('log_index <= 300', 'a')}, {_fold('log_index <= 900', 'b')} SELECT 'records' AS name, (SELECT count(*) FROM reca) AS before, (SELECT count(*) FROM recb) AS after UNION ALL SELECT 'nodes', (SELECT count(*) FROM noda), (SELECT count(*) FROM nodb) UNION ALL SELECT 'edges', 0, 0 UNION ALL SELECT 'meta', (SELECT count(*) FROM meta_), (SELECT count(*) FROM metb) UNION ALL SELECT 'events', (SELECT count(*) FROM lla), (SELECT count(*) FROM llb)".replace("meta_", "meta"),
    "soft_vs_hard_delete": f"WITH {_LOG}, {_fold()} SELECT (SELECT count(*) FROM rec) AS live, (SELECT count(*) FROM rec WHERE flags = 1) AS soft, (SELECT count(*) FROM ins) AS inserted",
    "drop_namespace": f"WITH {_LOG}, {_fold()} SELECT dp.ns AS namespace_id, count(id) AS later FROM dp LEFT JOIN rec ON rec.namespace_id = dp.ns GROUP BY dp.ns",
    "insert_rejects": f"WITH {_LOG} SELECT log_index, 'namespace' AS reason FROM l WHERE event_type = 'InsertRecord' AND log_index % 500 = 7",
    "pool_stats": f"WITH {_LOG}, {_fold()}, s AS (SELECT count(*) AS live, max(id) + 1 AS slots_used FROM rec) SELECT live, slots_used, CAST(2200 AS BIGINT) AS capacity, round(100.0 * slots_used / 2200, 2) AS fill_pct, CASE WHEN slots_used >= 2200 THEN 'full' WHEN round(100.0 * slots_used / 2200, 2) >= 90 THEN 'degraded' ELSE 'ok' END AS status FROM s",
    "gauges": f"WITH {_LOG}, {_fold()} SELECT 'records' AS name, count(*) AS live, CAST(200000 AS BIGINT) AS capacity, count(*) / 200000.0 AS fill_ratio FROM rec UNION ALL SELECT 'nodes', count(*), 50000, count(*) / 50000.0 FROM nod UNION ALL SELECT 'edges', 0, 0, 0.0",
    "shard_routing": f"WITH {_LOG} SELECT ns % 3 AS shard, string_agg(CAST(ns AS VARCHAR), ',' ORDER BY ns) AS namespaces FROM (SELECT DISTINCT ns FROM l) GROUP BY 1",
    "build_nodes_edges": "SELECT k AS kind, nodes, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS edges FROM (SELECT 3 AS k, count(*) AS nodes FROM customer UNION ALL SELECT 5, count(*) FROM orders)",
    "node_edges": "SELECT CAST(o_custkey AS BIGINT) * 2 AS src, count(*) AS degree FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "subgraph_bfs": f"WITH {_TALK}, {_reach('SELECT range * 1000 + 1 FROM range(30)', 3)} SELECT id, dist FROM near",
    "subgraph_edges": f"WITH {_TALK}, {_reach('SELECT range * 1000 FROM range(30)', 2)} SELECT src * 10000 + dst % 10000 * 10 + kind AS id, kind, src, dst FROM e WHERE src IN (SELECT id FROM near WHERE dist < 2)",
    "walk": f"WITH {_TALK}, {_reach('SELECT range * 1000 + 1 FROM range(10)', 5)} SELECT dist, count(*) AS nodes FROM near GROUP BY dist",
    "expand": f"WITH {_TALK}, {_reach('SELECT range * 1000 FROM range(20)', 1)} SELECT DISTINCT record_id FROM n JOIN near USING (id) WHERE record_id IS NOT NULL",
    "cascade_delete": f"WITH {_TALK}, g AS (SELECT id FROM n WHERE kind = 5 AND id % 3000 = 0) SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM g)) AS nodes, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)) AS edges",
    "graphrag": f"WITH {_R}, {_TALK}, hit AS (SELECT r.id, {_l2('r.fx', 'q.fx')} AS dist FROM r, (SELECT fx FROM r WHERE id = 0) q ORDER BY dist, r.id LIMIT 10), {_reach('SELECT min(n.id) FROM n JOIN hit ON hit.id = n.record_id GROUP BY n.record_id', 2)} SELECT id, dist FROM near",
    "contradict_pairs": f"WITH {_P}, c AS (SELECT a, b, {_dot('fa', 'fb')} / (sqrt(CAST({_dot('fa', 'fa')} AS DOUBLE)) * sqrt(CAST({_dot('fb', 'fb')} AS DOUBLE))) AS s FROM p) SELECT a, b, round(s, 9) AS similarity FROM c WHERE s >= 0.3",
    "consolidate": """WITH n AS (SELECT vec_id AS n FROM embeddings), x AS (SELECT n, unnest(range(5)) AS j FROM n) SELECT 5000 + n * 5 + j AS log_index, ['SoftDelete', 'InsertRecord', 'CreateNode', 'CreateNode', 'CreateEdge'][j + 1] AS event_type, CASE WHEN j IN (0, 2) THEN n * 2 WHEN j IN (1, 3) THEN 1000 + n END AS record_id, CASE j WHEN 2 THEN 2000 + n * 2 WHEN 3 THEN 2001 + n * 2 END AS node_id, CASE WHEN j = 4 THEN 3000 + n END AS edge_id, CASE WHEN j IN (2, 3) THEN 0 WHEN j = 4 THEN 7 END AS kind, CASE WHEN j = 4 THEN 2001 + n * 2 END AS src, CASE WHEN j = 4 THEN 2000 + n * 2 END AS dst FROM x""",
    "memory_upsert": """WITH n AS (SELECT vec_id AS n FROM embeddings), x AS (SELECT n, unnest(range(4)) AS j FROM n) SELECT 5000 + n * 4 + j AS log_index, ['InsertRecord', 'CreateNode', 'CreateEdge', 'SetMeta'][j + 1] AS event_type, CASE WHEN j < 2 THEN 1000 + n END AS record_id, CASE WHEN j = 1 THEN 2000 + n END AS node_id, CASE WHEN j = 2 THEN 3000 + n END AS edge_id, CASE WHEN j = 2 THEN n + 90000 END AS src, CASE WHEN j = 2 THEN 2000 + n END AS dst, CASE WHEN j = 3 THEN 'rec:' || (1000 + n) END AS key FROM x WHERE j <> 2 OR n % 2 = 0""",
    "resolve_entities": "SELECT CAST(sum(n_nationkey) FILTER (n_nationkey % 5 <> 0) AS BIGINT) AS src, CAST(sum(n_nationkey) FILTER (n_nationkey % 5 <> 0) AS BIGINT) AS dst, count(*) FILTER (n_nationkey % 5 <> 0) AS linked, count(*) FILTER (n_nationkey % 5 = 0) AS skipped FROM nation",
    "community_components": f"WITH {_COMM} SELECT id, community AS component FROM cm",
    "community_centroid": f"WITH {_MEAN} SELECT community, members, round(t, 6) AS total FROM sz LEFT JOIN (SELECT community, sum(m) AS t FROM mn GROUP BY community) USING (community)",
    "community_search": f"WITH {_MEAN}, q AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings WHERE vec_id = 0), s AS (SELECT community, sum(m * CAST(x AS DOUBLE)) / (greatest(sqrt(sum(m * m)), 1e-9) * greatest(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 1e-9)) AS sim FROM mn JOIN q USING (j) GROUP BY community) SELECT community, round(sim, 6) AS similarity, members FROM s JOIN sz USING (community) ORDER BY sim DESC, community LIMIT 5",
    "community_overview": f"WITH {_COMM}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM cm) SELECT community, count(*) AS members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 10) AS first FROM r GROUP BY community",
    "community_receipt": f"WITH {_COMM}, p AS (SELECT id // 100000 AS part, sha256(string_agg(id || ':' || community, ',' ORDER BY id)) AS h FROM cm GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY part)) AS receipt FROM p",
    "node_rejects": f"""WITH {_LOG}, b AS (SELECT rec, min(log_index) AS born, arg_min(ns, log_index) AS home FROM l WHERE event_type = 'InsertRecord' GROUP BY rec),
m AS (SELECT l.log_index, l.ns, l.rec, born, home FROM l LEFT JOIN b ON b.rec = l.rec WHERE event_type = 'CreateNode'),
w AS (SELECT m.*, EXISTS (SELECT 1 FROM l h WHERE h.event_type = 'HardDelete' AND h.rec = m.rec AND h.log_index > born AND h.log_index < m.log_index) OR EXISTS (SELECT 1 FROM l x WHERE x.event_type = 'DropNamespace' AND x.ns <> 0 AND x.ns = home AND x.log_index > born AND x.log_index < m.log_index) AS dead FROM m)
SELECT log_index, CASE WHEN born IS NULL OR born >= log_index OR dead THEN 'record' ELSE 'namespace' END AS reason FROM w WHERE born IS NULL OR born >= log_index OR dead OR home <> ns""",
    "shred_keys": f"""WITH {_LOG}, {_fold()} SELECT rec.id, flags + CASE WHEN born % 3 = 0 THEN 2 + CASE WHEN (born % 40) % 4 = 0 THEN 4 ELSE 0 END ELSE 0 END AS flags, CASE WHEN born % 3 = 0 AND (born % 40) % 4 = 0 THEN NULL ELSE metadata END AS metadata FROM rec JOIN (SELECT id, born FROM ins) USING (id)""",
    "insert_receipts_broken": f"WITH {_LOG} SELECT rec AS record_id FROM l WHERE event_type = 'InsertRecord' AND rec % 100 = 5",
    "citation_rates": f"""WITH {_TALK}, c AS (SELECT vec_id AS id FROM embeddings UNION ALL SELECT vec_id * 2 FROM embeddings), j AS (SELECT id, id IN (SELECT vec_id FROM embeddings) AS there, id IN (SELECT record_id FROM n WHERE record_id IS NOT NULL) AS linked FROM c)
SELECT round(count(*) FILTER (there) / CAST(count(*) AS DOUBLE), 6) AS existence, round(count(*) FILTER (there AND linked) / CAST(count(*) FILTER (there) AS DOUBLE), 6) AS provenance, count(*) AS citations FROM j""",
    "community_scope": f"WITH {_TALK} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS astray FROM n WHERE ns = 2",
    "community_members": f"WITH {_MEAN}, q AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings WHERE vec_id = 0), s AS (SELECT community, sum(m * CAST(x AS DOUBLE)) / (greatest(sqrt(sum(m * m)), 1e-9) * greatest(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 1e-9)) AS sim FROM mn JOIN q USING (j) GROUP BY community), t AS (SELECT community FROM s ORDER BY sim DESC, community LIMIT 5), k AS (SELECT cm.*, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM cm JOIN t USING (community)) SELECT community, count(*) AS members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 20) AS first FROM k GROUP BY community",
    "log_chain": f"""WITH RECURSIVE {_LOG}, dg AS (SELECT log_index AS i, log_index // 1000 AS segment, sha256(log_index || chr(31) || ts || chr(31) || event_type || chr(31) || coalesce(CAST(rec AS VARCHAR), chr(0)) || chr(31) || coalesce(CASE WHEN event_type = 'SetMeta' THEN key END, chr(0))) AS g FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY i) AS k, count(*) OVER (PARTITION BY segment) AS length FROM dg),
c AS (SELECT segment, k, length, sha256(repeat('0', 64) || chr(31) || g) AS h FROM r WHERE k = 1 UNION ALL SELECT r.segment, r.k, r.length, sha256(c.h || chr(31) || r.g) FROM c JOIN r ON r.segment = c.segment AND r.k = c.k + 1)
SELECT segment, h AS head, length FROM c WHERE k = length""",
    "state_hash": f"WITH {_LOG}, {_fold()}, h AS (SELECT id, sha256(id || chr(31) || namespace_id || chr(31) || tag || chr(31) || flags || chr(31) || coalesce(metadata, chr(0))) AS h FROM rec), p AS (SELECT id // 100000 AS part, sha256(string_agg(h, '' ORDER BY id)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY part)) AS state_hash FROM p",
    "log_chain_verify": "SELECT CAST(0 AS BIGINT) AS segment, i, 'digest' AS reason FROM (SELECT unnest([123, 777]) AS i)",
    "receipt_chain_verify": "SELECT false AS valid, CAST(17 AS BIGINT) AS broken_at",
    "recall_receipt": f"WITH {_R}, n AS (SELECT id, dist, row_number() OVER (ORDER BY dist, id) AS rank FROM (SELECT r.id, {_l2('r.fx', 'q.fx')} AS dist FROM r, (SELECT fx FROM r WHERE id = 0) q ORDER BY dist, r.id LIMIT 5)) SELECT sha256('s' || chr(31) || 'h' || chr(31) || '100' || chr(31) || '64' || chr(31) || '5' || chr(31) || string_agg(rank || ':' || id || ':' || dist, ',' ORDER BY rank)) AS receipt FROM n",
}
SQL["log_chain_verify"] = "SELECT CAST(0 AS BIGINT) AS segment, CAST(i AS BIGINT) AS i, 'digest' AS reason FROM (SELECT unnest([123, 777]) AS i)"


def _merkle() -> str:
    out = [f"WITH {_R}, m0 AS (SELECT id, i - 1 AS i, sha256('LEAF:' || (i - 1) || ':' || v) AS h FROM (SELECT id, unnest(fx) AS v, generate_subscripts(fx, 1) AS i FROM r))"]
    for k in range(1, 7):
        out.append(f"m{k} AS (SELECT id, i // 2 AS i, sha256('NODE:' || max(h) FILTER (i % 2 = 0) || ':' || coalesce(max(h) FILTER (i % 2 = 1), max(h) FILTER (i % 2 = 0))) AS h FROM m{k - 1} GROUP BY id, i // 2)")
    return ", ".join(out) + " SELECT id, h AS root FROM m6"


SQL["vector_merkle"] = _merkle()
SQL["insert_receipts"] = _merkle().replace(" SELECT id, h AS root FROM m6", "") + f""", {_LOG}, x AS (SELECT log_index, ns, rec, coalesce(h, '') AS root, sha256(coalesce(props, '')) AS metadata_hash FROM l LEFT JOIN m6 ON m6.id = rec WHERE event_type = 'InsertRecord')
SELECT rec AS record_id, metadata_hash, sha256(log_index || chr(31) || ns || chr(31) || rec || chr(31) || root || chr(31) || metadata_hash || chr(31) || repeat('0', 64)) AS receipt_hash FROM x"""
