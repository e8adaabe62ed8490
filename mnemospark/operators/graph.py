"""The property graph: neighbourhoods, cascades, search expansion, contradictions, event generators.

Tables: nodes (id, kind, record_id, namespace_id), edges (id, kind, src, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from ..functions.lineage import cut

# fixed values of the kinds
NODE_KINDS = {"Record": 0, "Concept": 1, "Agent": 2, "User": 3, "Tool": 4, "Document": 5, "Chunk": 6}
EDGE_KINDS = {"Relation": 0, "Follows": 1, "InEpisode": 2, "ByAgent": 3, "Mentions": 4, "RefersTo": 5, "ParentOf": 6, "Supersedes": 7, "Contradicts": 8}
MAX_DEPTH, MAX_WALK = 4, 10


def out_edges(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("id").alias("edge_id"), F.col("dst").alias("to_node"), "kind")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends exist and share a namespace; loops and repeats are allowed."""
    a = nodes.select(F.col("id").alias("src"), F.col("namespace_id").alias("ns_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("namespace_id").alias("ns_b"))
    return edges.join(a, "src").join(b, "dst").where("ns_a = ns_b").drop("ns_a", "ns_b")


def reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, dist) of the nodes within ``depth`` outgoing steps of the seeds (id); unknown seeds vanish.

    One join a step: the frontier with the edges, less what has been visited.  Beyond two steps each frontier is
    written to the shared folder, or every step would compute all earlier ones again.
    """
    known = nodes.select("id")
    visited = seeds.select("id").distinct().join(known, "id", "left_semi").withColumn("dist", F.lit(0))
    frontier = visited
    for step in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = found.join(known, "id", "left_semi").join(visited.select("id"), "id", "left_anti").withColumn("dist", F.lit(step))
        if depth > 2 and step < depth:
            frontier = cut(frontier, "frontier")
        visited = visited.unionByName(frontier)
    return visited


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``depth`` (at most 4) and the edges that leave nodes nearer than that."""
    depth = max(0, min(depth, MAX_DEPTH))
    near = reach(nodes, edges, seeds, depth)
    inner = near.where(F.col("dist") < depth).select(F.col("id").alias("src"))
    return near, edges.join(inner, "src", "left_semi").select("id", "kind", "src", "dst")


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return reach(nodes, edges, seeds, max(0, min(depth, MAX_WALK)))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Distinct records of the nodes that a walk reaches."""
    near = walk(nodes, edges, seeds, depth)
    return nodes.join(near.select("id"), "id", "left_semi").where("record_id is not null").select("record_id").distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given nodes (id) and every edge into or out of them."""
    g = gone.select(F.col("id").alias("g"))
    return nodes.join(g, nodes.id == F.col("g"), "left_anti"), edges.join(g, F.col("src") == F.col("g"), "left_anti").join(g, F.col("dst") == F.col("g"), "left_anti")


def node_of_record(nodes: DataFrame) -> DataFrame:
    """(record_id, node_id): the first node of each record."""
    return nodes.where("record_id is not null").groupBy("record_id").agg(F.min("id").alias("node_id"))


def search_graph(hits: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The subgraph around search hits (id), from the first node of each hit's record."""
    seeds = hits.select(F.col("id").alias("record_id")).join(node_of_record(nodes), "record_id").select(F.col("node_id").alias("id"))
    return subgraph(nodes, edges, seeds, depth)


def contradictions(pairs: DataFrame, records: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose records' cosine reaches the threshold."""
    x = records.select(F.col("id").alias("a"), F.col("fx").alias("fa"))
    y = records.select(F.col("id").alias("b"), F.col("fx").alias("fb"))
    out = pairs.join(x, "a").join(y, "b").withColumn("similarity", fx.cosine(F.col("fa"), F.col("fb")))
    return out.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def open_contradictions(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == EDGE_KINDS["Contradicts"]).select("id", "src", "dst")


def resolve_names(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, label) of relations (source, target, label) whose ends name entities (name, id); and one row
    (linked, skipped)."""
    one = entities.groupBy("name").agg(F.min("id").alias("id"))
    a, b = one.select(F.col("name").alias("source"), F.col("id").alias("src")), one.select(F.col("name").alias("target"), F.col("id").alias("dst"))
    joined = relations.join(a, "source", "left").join(b, "target", "left")
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return joined.where(both).select("src", "dst", "label"), joined.agg(F.count_if(both).alias("linked"), F.count_if(~both).alias("skipped"))


def consolidate(requests: DataFrame, next_record: int, next_node: int, next_edge: int, next_index: int) -> DataFrame:
    """The events of consolidations (n, old_record, new_fx, namespace_id), n dense from 0: the old record is softly
    deleted, the new one inserted, each gets a node, and an edge Supersedes leads from the new to the old."""
    n = F.col("n")
    none = F.lit(None)

    def event(k: int, event_type: str, **own):
        base = {"log_index": F.lit(next_index) + n * 5 + k, "event_type": F.lit(event_type), "namespace_id": F.col("namespace_id"), "record_id": none.cast("long"), "node_id": none.cast("long"), "edge_id": none.cast("long"), "kind": none.cast("int"), "src": none.cast("long"), "dst": none.cast("long"), "fx": none.cast("array<int>")}
        return F.struct(*(v.alias(k_) for k_, v in (base | own).items()))

    old, new = F.lit(next_node) + n * 2, F.lit(next_node) + n * 2 + 1
    events = F.array(
        event(0, "SoftDelete", record_id=F.col("old_record")),
        event(1, "InsertRecord", record_id=F.lit(next_record) + n, fx=F.col("new_fx")),
        event(2, "CreateNode", node_id=old, kind=F.lit(NODE_KINDS["Record"]), record_id=F.col("old_record")),
        event(3, "CreateNode", node_id=new, kind=F.lit(NODE_KINDS["Record"]), record_id=F.lit(next_record) + n),
        event(4, "CreateEdge", edge_id=F.lit(next_edge) + n, kind=F.lit(EDGE_KINDS["Supersedes"]), src=new, dst=old),
    )
    return requests.select(F.explode(events).alias("e")).select("e.*")


def upsert(requests: DataFrame, next_record: int, next_node: int, next_edge: int, next_index: int) -> DataFrame:
    """The events of memory writes (n, fx, metadata, document_node, namespace_id): a record, its chunk node, the
    ParentOf edge from its document's node if there is one, and the meta row."""
    n, none = F.col("n"), F.lit(None)

    def event(k: int, event_type: str, **own):
        base = {"log_index": F.lit(next_index) + n * 4 + k, "event_type": F.lit(event_type), "namespace_id": F.col("namespace_id"), "record_id": none.cast("long"), "node_id": none.cast("long"), "edge_id": none.cast("long"), "kind": none.cast("int"), "src": none.cast("long"), "dst": none.cast("long"), "fx": none.cast("array<int>"), "key": none.cast("string"), "value": none.cast("string")}
        return F.struct(*(v.alias(k_) for k_, v in (base | own).items()))

    record = F.lit(next_record) + n
    events = F.array(
        event(0, "InsertRecord", record_id=record, fx=F.col("fx")),
        event(1, "CreateNode", node_id=F.lit(next_node) + n, kind=F.lit(NODE_KINDS["Chunk"]), record_id=record),
        event(2, "CreateEdge", edge_id=F.lit(next_edge) + n, kind=F.lit(EDGE_KINDS["ParentOf"]), src=F.col("document_node"), dst=F.lit(next_node) + n),
        event(3, "SetMeta", key=F.concat(F.lit("rec:"), record.cast("string")), value=F.col("metadata")),
    )
    out = requests.select(F.explode(events).alias("e")).select("e.*")
    return out.where("event_type <> 'CreateEdge' or src is not null")
