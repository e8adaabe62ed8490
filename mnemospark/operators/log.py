"""The append-only event log: numbering, folding into state, time travel, timeline, differences.

A log row is (log_index, ts, namespace_id, event_type, record_id, node_id, edge_id, kind, src, dst, fx, metadata, tag,
key, value, key_id, request_id), nulls where an event doesn't need the column.  State is derived by grouped
"latest event" queries over the log; nothing is applied row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = (
    "log_index long, ts long, namespace_id int, event_type string, record_id long, node_id long, edge_id long, kind int, src long, dst long, "
    "fx array<int>, metadata string, tag long, key string, value string, key_id string, request_id string"
)
SOFT, ENCRYPTED, SHREDDED = 1, 2, 4
MAX_NAMESPACES, MAX_METADATA = 1024, 65536


def number(rows: DataFrame, order: str, name: str = "id", width: int = 1_000_000) -> DataFrame:
    """Dense numbers from 0 in the order of an integer column, without sorting the whole table in one task.

    Rows are numbered inside ranges of ``width`` values of the column; the ranges' counts, one small row each, give
    where each range begins.
    """
    part = F.floor(F.col(order) / width).alias("part")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    begin = counts.withColumn("begin", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = rows.withColumn("part", part).withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return own.join(begin, "part").withColumn(name, F.col("begin") + F.col("own")).drop("part", "own", "begin")


def dedup_requests(log: DataFrame) -> DataFrame:
    """The first event of each request id; events without one all stay."""
    first = log.where("request_id is not null").groupBy("request_id").agg(F.min("log_index").alias("log_index"))
    repeated = log.where("request_id is not null").select("log_index", "request_id").join(first, ["log_index", "request_id"], "left_anti").select("log_index")
    return log.join(repeated, "log_index", "left_anti")


@dataclass
class State:
    """The tables that a log folds into."""

    records: DataFrame
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


def _last(log: DataFrame, kind: str, key: str, **values: str) -> DataFrame:
    """Per key the last event of a kind: its log_index and values."""
    aggs = [F.max("log_index").alias(f"{kind}_at"), *(F.max_by(v, "log_index").alias(k) for k, v in values.items())]
    return log.where(F.col("event_type") == kind).groupBy(key).agg(*aggs)


def fold(log: DataFrame) -> State:
    """The state after all events of an accepted log.

    A record lives from its insert (or encrypted insert) to its hard delete or the drop of its namespace.  A soft
    delete sets flag 1, an encrypted insert has flag 2 and no vector, shredding its key sets flag 4 and takes the
    metadata.  The last metadata update wins.  Updates and deletes before the insert don't count.  Deleting a node
    takes its edges.  Namespace 0 can't be dropped.  Meta keys: the last value wins.
    """
    inserts = log.where(F.col("event_type").isin("InsertRecord", "InsertEncrypted")).select(
        F.col("record_id").alias("id"), "namespace_id", F.col("log_index").alias("born"), F.coalesce("tag", F.lit(0)).alias("tag"), "fx", F.col("metadata").alias("first_metadata"), "key_id", (F.col("event_type") == "InsertEncrypted").alias("encrypted"), F.col("ts").alias("created_at")
    )
    inserts = inserts.groupBy("id").agg(F.min_by(F.struct(*[c for c in inserts.columns if c != "id"]), "born").alias("r")).select("id", "r.*")
    soft = _last(log, "SoftDelete", "record_id")
    hard = _last(log, "HardDelete", "record_id")
    update = _last(log, "UpdateMetadata", "record_id", new_metadata="metadata")
    drops = log.where("event_type = 'DropNamespace' and namespace_id <> 0").groupBy("namespace_id").agg(F.max("log_index").alias("dropped_at"))
    shred = log.where("event_type = 'ShredKey'").groupBy("key_id").agg(F.max("log_index").alias("shred_at"))
    r = inserts
    for side in (soft, hard, update):
        r = r.join(side.withColumnRenamed("record_id", "id"), "id", "left")
    drops = F.broadcast(drops)  # a row a namespace, MAX_NAMESPACES at most
    r = r.join(drops, "namespace_id", "left")
    # records without a key would all meet in one task
    r = r.where("key_id is not null").join(shred, "key_id", "left").unionByName(r.where("key_id is null").withColumn("shred_at", F.lit(None).cast("long")))
    after = lambda c: F.coalesce(F.col(c) > F.col("born"), F.lit(False))
    shredded = F.col("encrypted") & after("shred_at")
    flags = F.when(after("SoftDelete_at"), SOFT).otherwise(0) + F.when(F.col("encrypted"), ENCRYPTED).otherwise(0) + F.when(shredded, SHREDDED).otherwise(0)
    metadata = F.when(shredded, None).when(after("UpdateMetadata_at"), F.col("new_metadata")).otherwise(F.col("first_metadata"))
    records = r.where(~after("HardDelete_at") & ~after("dropped_at")).select("id", "namespace_id", "tag", flags.alias("flags"), "fx", metadata.alias("metadata"), "created_at")

    made = log.where("event_type = 'CreateNode'").groupBy(F.col("node_id").alias("id")).agg(F.min_by(F.struct(F.col("log_index").alias("born"), "kind", "record_id", "namespace_id"), "log_index").alias("n")).select("id", "n.*")
    gone = _last(log, "DeleteNode", "node_id").withColumnRenamed("node_id", "id")
    nodes = made.join(gone, "id", "left").join(drops, "namespace_id", "left").where(~after("DeleteNode_at") & ~after("dropped_at")).select("id", "kind", "record_id", "namespace_id")
    drawn = log.where("event_type = 'CreateEdge'").groupBy(F.col("edge_id").alias("id")).agg(F.min_by(F.struct(F.col("log_index").alias("born"), "kind", "src", "dst"), "log_index").alias("e")).select("id", "e.*")
    cut = _last(log, "DeleteEdge", "edge_id").withColumnRenamed("edge_id", "id")
    alive = nodes.select(F.col("id").alias("n"))
    edges = drawn.join(cut, "id", "left").where(~after("DeleteEdge_at")).select("id", "kind", "src", "dst")
    edges = edges.join(alive, edges.src == alive.n, "left_semi").join(alive, F.col("dst") == alive.n, "left_semi")
    meta = log.where("event_type = 'SetMeta'").groupBy("key").agg(F.max_by("value", "log_index").alias("value"))
    return State(records, nodes, edges, meta)


def as_of_index(log: DataFrame, index: int) -> DataFrame:
    """The log up to and including an index; an index beyond the log is an error."""
    last = log.agg(F.max("log_index")).first()[0]
    if last is None or index > last or index < 0:
        raise ValueError(f"no log index {index}")
    return log.where(F.col("log_index") <= index)


def index_at(log: DataFrame, ts: int) -> int | None:
    """The last index whose time is not after ``ts``."""
    return log.where(F.col("ts") <= ts).agg(F.max("log_index")).first()[0]


def as_of_time(log: DataFrame, ts: int) -> DataFrame:
    """The log up to a time; before its first event, nothing."""
    at = index_at(log, ts)
    return log.where(F.lit(False)) if at is None else log.where(F.col("log_index") <= at)


def parse_time(text: str | None) -> int | None:
    """Unix seconds of an ISO-8601 UTC time; None for what can't be read."""
    from datetime import datetime, timezone

    try:
        t = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


def timeline(log: DataFrame, start: str | int | None = None, end: str | int | None = None) -> DataFrame:
    """The log's events in a time range, both ends included; a bound that can't be read is ignored."""
    low = parse_time(start) if isinstance(start, str) else start
    high = parse_time(end) if isinstance(end, str) else end
    out = log
    if low is not None:
        out = out.where(F.col("ts") >= low)
    if high is not None:
        out = out.where(F.col("ts") <= high)
    return out.select("log_index", "ts", "namespace_id", "event_type", "record_id", "node_id", "edge_id", "key")


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n"))


def rejects(log: DataFrame, dim: int | None = None) -> DataFrame:
    """(log_index, reason) of inserts that break a rule: dimension, namespace, metadata size, number out of order."""
    ins = log.where(F.col("event_type") == "InsertRecord")
    lock = dim if dim is not None else (ins.where("fx is not null").agg(F.min_by(F.size("fx"), "log_index")).first()[0])
    numbered = number(ins, "log_index", "expected")
    reason = (
        F.when(~F.col("namespace_id").between(0, MAX_NAMESPACES - 1), "namespace")
        .when(F.size("fx") != F.lit(lock), "dimension")
        .when(F.octet_length("metadata") > MAX_METADATA, "metadata")
        .when(F.col("record_id") != F.col("expected"), "order")
    )
    return numbered.select("log_index", reason.alias("reason")).where("reason is not null")


def node_rejects(log: DataFrame) -> DataFrame:
    """(log_index, reason) of CreateNode events that name a record which isn't alive in the node's namespace by then."""
    made = log.where("event_type = 'CreateNode' and record_id is not null").select("log_index", F.col("namespace_id").alias("ns"), "record_id")
    born = log.where(F.col("event_type").isin("InsertRecord", "InsertEncrypted")).groupBy("record_id").agg(F.min_by(F.struct("log_index", "namespace_id"), "log_index").alias("r")).select("record_id", F.col("r.log_index").alias("born"), F.col("r.namespace_id").alias("home"))
    gone = log.where("event_type = 'HardDelete'").join(born, "record_id").where("log_index > born").groupBy("record_id").agg(F.min("log_index").alias("gone"))
    drops = log.where("event_type = 'DropNamespace' and namespace_id <> 0").groupBy(F.col("namespace_id").alias("home")).agg(F.sort_array(F.collect_set("log_index")).alias("drops"))
    j = made.join(born, "record_id", "left").join(gone, "record_id", "left").join(F.broadcast(drops), "home", "left")
    dropped = F.exists(F.coalesce("drops", F.array().cast("array<long>")), lambda x: (x > F.col("born")) & (x < F.col("log_index")))
    alive = (F.col("born") < F.col("log_index")) & ~F.coalesce(F.col("gone") < F.col("log_index"), F.lit(False)) & ~dropped
    why = F.when(~F.coalesce(alive, F.lit(False)), "record").when(F.col("home") != F.col("ns"), "namespace")
    return j.select("log_index", why.alias("reason")).where("reason is not null")


def difference(log: DataFrame, a: int, b: int) -> DataFrame:
    """(name, before, after): counts of live records, nodes, edges and meta keys at two indexes, and events between."""
    one, two = fold(log.where(F.col("log_index") <= a)), fold(log.where(F.col("log_index") <= b))
    out = None
    for name in ("records", "nodes", "edges", "meta"):
        x = getattr(one, name).agg(F.count("*").alias("before")).crossJoin(getattr(two, name).agg(F.count("*").alias("after"))).select(F.lit(name).alias("name"), "before", "after")
        out = x if out is None else out.unionByName(x)
    events = log.agg(F.count_if(F.col("log_index") <= a).alias("before"), F.count_if(F.col("log_index") <= b).alias("after")).select(F.lit("events").alias("name"), "before", "after")
    return out.unionByName(events)


def pool_stats(records: DataFrame, capacity: int) -> DataFrame:
    """One row: live records, slots used, capacity, fill in percent and status (ok, degraded from 90, full)."""
    slots = F.coalesce(F.max("id") + 1, F.lit(0))
    fill = F.round(100.0 * F.col("slots_used") / capacity, 2)
    out = records.agg(F.count("*").alias("live"), slots.alias("slots_used")).withColumn("capacity", F.lit(capacity).cast("long")).withColumn("fill_pct", fill)
    return out.withColumn("status", F.when(F.col("slots_used") >= capacity, "full").when(F.col("fill_pct") >= 90, "degraded").otherwise("ok"))


def gauges(state, capacity: dict[str, int]) -> DataFrame:
    """(name, live, capacity, fill_ratio) of the folded state's tables that ``capacity`` names; a capacity of 0 is filled to 0."""
    out = None
    for name, most in capacity.items():
        fill = F.col("live") / F.lit(float(most)) if most > 0 else F.lit(0.0)
        one = getattr(state, name).agg(F.count("*").alias("live")).select(F.lit(name).alias("name"), "live", F.lit(most).cast("long").alias("capacity"), fill.alias("fill_ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def shard_routing(namespaces: DataFrame, shards: int) -> DataFrame:
    """(shard, namespaces): namespace modulo the number of shards."""
    return namespaces.select("namespace_id").distinct().groupBy(F.pmod("namespace_id", F.lit(shards)).alias("shard")).agg(F.array_join(F.sort_array(F.collect_list("namespace_id")), ",").alias("namespaces"))
