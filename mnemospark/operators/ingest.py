"""Ingest: validation, embedding, the write events of a document, and the difference to an earlier version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunking, log
from .graph import EDGE_KINDS, NODE_KINDS

MAX_BYTES = 50 * 1024 * 1024


def validation_error(text: Column, mime: Column, pages: Column | None = None, *, max_bytes: int = MAX_BYTES, max_pages: int | None = None) -> Column:
    """The first failing check as a code (empty, too_large, too_many_pages, protected), null if all pass."""
    code = F.when(F.coalesce(chunking.trim(text), F.lit("")) == "", "empty").when(F.octet_length(text) > max_bytes, "too_large")
    if pages is not None and max_pages is not None:
        code = code.when(pages > max_pages, "too_many_pages")
    return code.when(mime == "application/pdf+protected", "protected")


def hash_embedding(text: str, dim: int) -> list[float]:
    """A text's own vector in [-1, 1] from chained SHA-256 digests; for tests, no model."""
    seed = hashlib.sha256(text.encode()).digest()
    blocks = (dim + 31) // 32
    data = b"".join(hashlib.sha256(seed + k.to_bytes(4, "little")).digest() for k in range(blocks))[:dim]
    return (np.frombuffer(data, np.uint8) / 127.5 - 1.0).tolist()


def zero_embedding(text: str, dim: int) -> list[float]:
    return [0.0] * dim


EMBEDDERS: dict[str, Callable[[str, int], list[float]]] = {"hash": hash_embedding, "zero": zero_embedding}


def embed(chunks: DataFrame, embedder: str | Callable[[str, int], list[float]] = "hash", dim: int = 64, text_col: str = "text") -> DataFrame:
    """The rows with a vector column ``vec``; a callable of (text, dim) may call any model."""
    fn = EMBEDDERS[embedder] if isinstance(embedder, str) else embedder

    def run(batches):
        for b in batches:
            if b.num_rows:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.append_column("vec", pa.array([fn(t or "", dim) for t in texts], pa.list_(pa.float32())))

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))]))


def pipeline(docs: DataFrame, *, strategy: str = "auto", size: int = 1000, overlap: int = 200, embedder="hash", dim: int = 64) -> DataFrame:
    """(doc_id, idx, title, text, content_hash, strategy, vec) of every document that passes validation."""
    fine = docs.where(validation_error(F.col("text"), F.lit("text/plain")).isNull())
    return embed(chunking.chunk(fine, strategy, size, overlap), embedder, dim)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, content_hash, n, action): keep, add or remove, comparing chunks (doc_id, content_hash) as multisets."""
    a, b = (t.select("doc_id", "content_hash").groupBy("doc_id", "content_hash").agg(F.count("*").alias(n)) for t, n in ((old, "a"), (new, "b")))
    j = a.join(b, ["doc_id", "content_hash"], "full").select("doc_id", "content_hash", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    parts = F.array(F.struct(F.lit("keep").alias("action"), F.least("a", "b").alias("n")), F.struct(F.lit("add").alias("action"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("n")), F.struct(F.lit("remove").alias("action"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n")))
    return j.select("doc_id", "content_hash", F.explode(parts).alias("p")).select("doc_id", "content_hash", "p.n", "p.action").where("n > 0")


#: A document has fewer chunks than this (its text has at most 50 MB).
CHUNKS = 1_000_000


def events(chunks: DataFrame, next_record: int = 0, next_node: int = 0, next_edge: int = 0, next_index: int = 0) -> DataFrame:
    """The log events that write chunks (doc_id, idx, fx, metadata, namespace_id), in order of document and chunk: for each
    document a node, then for each chunk its record, its node, the ParentOf edge from the document's node and the meta
    row ``record:{id}``.  Numbers are dense from the given ones on."""
    docs = log.number(chunks.select("doc_id").distinct(), "doc_id", "d")
    rows = log.number(chunks.withColumn("at", F.col("doc_id") * CHUNKS + F.col("idx")), "at", "n", 1_000 * CHUNKS)
    first = chunks.groupBy("doc_id").agg(F.min("namespace_id").alias("namespace_id"), F.min("idx").alias("idx"))
    # before chunk n of document d stand d + 1 document events and n times four chunk events
    record, node, edge, index = (F.lit(x) for x in (next_record, next_node, next_edge, next_index))
    both = rows.join(docs, "doc_id")
    own_node = node + F.col("d") + F.col("n") + 1
    opened = both.join(first.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi").select("namespace_id", "d", "n")
    none = F.lit(None)

    def event(at, event_type: str, **own):
        base = {"log_index": at, "event_type": F.lit(event_type), "namespace_id": F.col("namespace_id"), "record_id": none.cast("long"), "node_id": none.cast("long"), "edge_id": none.cast("long"), "kind": none.cast("int"), "src": none.cast("long"), "dst": none.cast("long"), "fx": none.cast("array<int>"), "key": none.cast("string"), "value": none.cast("string")}
        return F.struct(*(v.alias(k) for k, v in (base | own).items()))

    doc_node = F.col("doc_node")
    begin = index + F.col("d") + 1 + F.col("n") * 4
    documents = opened.select(event(begin - 1, "CreateNode", node_id=node + F.col("d") + F.col("n"), kind=F.lit(NODE_KINDS["Document"])).alias("e"))
    parents = opened.select("d", (node + F.col("d") + F.col("n")).alias("doc_node"))
    rid = record + F.col("n")
    written = both.join(parents, "d").select(F.explode(F.array(
        event(begin, "InsertRecord", record_id=rid, fx=F.col("fx")),
        event(begin + 1, "CreateNode", node_id=own_node, kind=F.lit(NODE_KINDS["Chunk"]), record_id=rid),
        event(begin + 2, "CreateEdge", edge_id=edge + F.col("n"), kind=F.lit(EDGE_KINDS["ParentOf"]), src=doc_node, dst=own_node),
        event(begin + 3, "SetMeta", key=F.concat(F.lit("record:"), rid.cast("string")), value=F.col("metadata")),
    )).alias("e"))
    return documents.unionByName(written).select("e.*")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, content_hash, action, record_id, idx): what a new version does to each chunk, as multisets by hash: the
    record (of old: doc_id, content_hash, idx, record_id) it keeps or softly deletes, or the chunk (of new: doc_id,
    content_hash, idx) that is added."""
    by = W.partitionBy("doc_id", "content_hash").orderBy("idx")
    a = old.select("doc_id", "content_hash", "record_id", F.row_number().over(by).alias("k"))
    b = new.select("doc_id", "content_hash", "idx", F.row_number().over(by).alias("k"))
    j = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), ["doc_id", "content_hash", "k"], "full")
    action = F.when(F.col("was") & F.col("is"), "keep").when(F.col("was"), "remove").otherwise("add")
    return j.select("doc_id", "content_hash", action.alias("action"), "record_id", "idx")


def removal_events(changed: DataFrame, next_index: int) -> DataFrame:
    """(log_index, event_type, record_id): a soft delete for every chunk that is removed, in order of record."""
    gone = log.number(changed.where("action = 'remove'").select("record_id"), "record_id", "n")
    return gone.select((F.lit(next_index) + F.col("n")).alias("log_index"), F.lit("SoftDelete").alias("event_type"), "record_id")


def batch_insert(rows: DataFrame, seen: DataFrame, next_id: int) -> DataFrame:
    """New rows (pos, request_id, fx) with record ids from ``next_id`` on, in order of pos; rows whose request id is in
    ``seen`` (request_id) or earlier in the batch are left out."""
    first = rows.where("request_id is not null").groupBy("request_id").agg(F.min("pos").alias("pos"))
    fresh = rows.where("request_id is null").unionByName(rows.join(first, ["request_id", "pos"], "left_semi").join(seen.select("request_id"), "request_id", "left_anti").select(*rows.columns))
    return log.number(fresh, "pos", "id").withColumn("id", F.col("id") + next_id)


def encrypt(rows: DataFrame, key: str) -> DataFrame:
    """Rows (id, metadata) as encrypted records: the metadata as ciphertext, no vector, flag 2."""
    return rows.select("id", F.base64(F.aes_encrypt(F.col("metadata").cast("binary"), F.lit(key).cast("binary"), F.lit("GCM"))).alias("metadata"), F.lit(log.ENCRYPTED).alias("flags"))


def decrypt(rows: DataFrame, key: str) -> DataFrame:
    return rows.select("id", F.aes_decrypt(F.unbase64("metadata"), F.lit(key).cast("binary"), F.lit("GCM")).cast("string").alias("metadata"))
