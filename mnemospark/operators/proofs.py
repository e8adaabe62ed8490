"""Receipts, hash chains and Merkle roots with SHA-256.

A chain is one hash per row over the row's fields and its predecessor's hash, so it is made in log order; checking one
is a comparison of each row with the row before, and runs in parallel.  Segments of a long log are chained apart and
their heads chained in turn.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS, SEPARATOR = "0" * 64, "\x1f"
LEAF, NODE = "LEAF", "NODE"


def receipt_hash(previous: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, previous, *fields), 256)


def section_receipt(previous: Column, query: Column, visited: Column, ranges: Column, evidence: Column, answer: Column) -> Column:
    """A struct with the hashes of query, evidence and answer, and the receipt's own."""
    q, e, a = (F.sha2(F.coalesce(x, F.lit("")), 256) for x in (query, evidence, answer))
    return F.struct(q.alias("query_hash"), visited.alias("visited"), ranges.alias("ranges"), e.alias("evidence_hash"), a.alias("answer_hash"), previous.alias("prev_hash"), receipt_hash(previous, q, visited, ranges, e, a).alias("receipt_hash"))


INSERT_FIELDS = ("log_index", "namespace_id", "record_id", "vector_root", "metadata_hash", "prev_hash")


def insert_receipts(log: DataFrame, previous: str = GENESIS) -> DataFrame:
    """One receipt for every inserted record: its place in the log, the root over its vector, the hash of its metadata,
    and a hash over all of these and ``previous``."""
    root = F.coalesce(merkle_root(F.col("fx")), F.lit(""))
    own = log.where("event_type = 'InsertRecord'").select("log_index", "namespace_id", "record_id", root.alias("vector_root"), F.sha2(F.coalesce("metadata", F.lit("")), 256).alias("metadata_hash"), F.lit(previous).alias("prev_hash"))
    return own.withColumn("receipt_hash", row_digest(*INSERT_FIELDS))


def broken_insert_receipts(receipts: DataFrame) -> DataFrame:
    """The receipts whose own hash doesn't follow from their fields."""
    return receipts.where(~F.coalesce(F.col("receipt_hash") == row_digest(*INSERT_FIELDS), F.lit(False)))


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def chain(rows: DataFrame, segment: Column, order: str = "i", digest: str = "digest") -> DataFrame:
    """(segment, i, prev_hash, chain_hash) of (i, digest): inside each segment from the genesis hash on.

    A segment is handled by one task in order; choose segments of bounded length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        previous, out = GENESIS, []
        for r in pdf.sort_values(order).itertuples():
            h = hashlib.sha256(f"{previous}{SEPARATOR}{getattr(r, digest)}".encode()).hexdigest()
            out.append((r.segment, getattr(r, order), previous, h))
            previous = h
        return pd.DataFrame(out, columns=["segment", "i", "prev_hash", "chain_hash"])

    return rows.select(segment.cast("long").alias("segment"), F.col(order).cast("long").alias(order), digest).groupBy("segment").applyInPandas(run, "segment long, i long, prev_hash string, chain_hash string")


def heads(chained: DataFrame) -> DataFrame:
    """(segment, head, length): the last hash of each segment."""
    return chained.groupBy("segment").agg(F.max_by("chain_hash", "i").alias("head"), F.count("*").alias("length"))


def broken(chained: DataFrame, rows: DataFrame, segment: Column, order: str = "i", digest: str = "digest") -> DataFrame:
    """(segment, i, reason): rows whose hash or predecessor doesn't agree with the stored digests, or that are missing."""
    r = rows.select(segment.cast("long").alias("segment"), F.col(order).cast("long").alias("i"), digest)
    w = W.partitionBy("segment").orderBy("i")
    j = chained.join(r, ["segment", "i"], "full")
    j = j.withColumn("want_prev", F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS)))
    want = F.sha2(F.concat_ws(SEPARATOR, "prev_hash", digest), 256)
    why = F.when(F.col("chain_hash").isNull(), "unchained").when(F.col(digest).isNull(), "missing").when(F.col("prev_hash") != F.col("want_prev"), "link").when(F.col("chain_hash") != want, "digest")
    return j.select("segment", "i", why.alias("reason")).where("reason is not null")


def verify_receipts(receipts: DataFrame) -> DataFrame:
    """One row (valid, broken_at) for receipts (i, query_hash, visited, ranges, evidence_hash, answer_hash, prev_hash,
    receipt_hash): broken_at is the first i whose hash or predecessor doesn't agree."""
    before = receipts.select((F.col("i") + 1).alias("i"), F.col("receipt_hash").alias("before"))
    first = receipts.agg(F.min("i").alias("first"))
    j = receipts.join(before, "i", "left").crossJoin(F.broadcast(first))
    want = F.when(F.col("i") == F.col("first"), F.lit(GENESIS)).otherwise(F.col("before"))
    own = receipt_hash(F.col("prev_hash"), *(F.col(c) for c in ("query_hash", "visited", "ranges", "evidence_hash", "answer_hash")))
    bad = ~F.coalesce((F.col("prev_hash") == want) & (F.col("receipt_hash") == own), F.lit(False))
    return j.agg(F.min(F.when(bad, F.col("i"))).alias("broken_at")).select(F.col("broken_at").isNull().alias("valid"), "broken_at")


def merkle_root(values: Column) -> Column:
    """The root over an array of integers: leaves hash position and value, an odd last one is paired with itself."""
    leaves = F.transform(values, lambda v, i: F.sha2(F.concat_ws(":", F.lit(LEAF), i, v), 256))

    def up(level: Column) -> Column:
        n = F.size(level)
        pairs = F.sequence(F.lit(0), F.greatest(F.ceil(n / 2).cast("int") - 1, F.lit(0)))
        return F.transform(pairs, lambda p: F.sha2(F.concat_ws(":", F.lit(NODE), F.get(level, p * 2), F.coalesce(F.get(level, p * 2 + 1), F.get(level, p * 2))), 256))

    # sixteen halvings reach one node from 65,536 values, the largest dimension
    root = F.aggregate(F.sequence(F.lit(1), F.lit(16)), leaves, lambda level, _: F.when(F.size(level) > 1, up(level)).otherwise(level))
    return F.when(F.size(values) > 0, F.get(root, F.lit(0)))


def state_hash(table: DataFrame, key: str, columns: list[str], width: int = 100_000) -> DataFrame:
    """One row: a hash over all rows in key order, by ranges of the key, so that no task sorts the table."""
    part = table.select(F.floor(F.col(key) / width).alias("part"), F.col(key).alias("k"), row_digest(key, *columns).alias("h")).groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda s: s["h"]), ""), 256).alias("state_hash"))


def recall_receipt(results: DataFrame, state: str, log_head: str, height: int, dim: int, k: int) -> DataFrame:
    """One row: a hash over the state, the log's head and height, the query's shape and the ranked results (rank, id, dist)."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))), lambda s: F.concat_ws(":", s["rank"], s["id"], s["dist"])), ",")
    return results.agg(F.sha2(F.concat_ws(SEPARATOR, F.lit(state), F.lit(log_head), F.lit(height), F.lit(dim), F.lit(k), own), 256).alias("receipt"))
