"""The read a user asks for: one search with all its options, over tables or over the past of a log."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from . import bm25, filters, log, search


def resolve_collection(collections: DataFrame, name: str | None) -> int:
    """The namespace of a collection (name, namespace_id); none and ``default`` are 0, an unknown name is an error."""
    if name in (None, "default"):
        return 0
    row = collections.where(F.col("name") == name).select("namespace_id").first()
    if row is None:
        raise LookupError(f"no collection {name!r}")
    return row[0]


def find(
    records: DataFrame, query: DataFrame, k: int, *, namespace: int | None = None, tag: int | None = None, metadata: dict | None = None, now: int = 0, half_life: int = 0, docs: DataFrame | None = None, text: str | None = None, pool: bool = False
) -> DataFrame:
    """(id, distance, score, metadata, position) of the best k records for the query row (q).

    Namespace, tag, flags and metadata are tested before the ranking, so k records come back whenever k pass; with
    ``pool`` metadata are tested behind a bounded pool of candidates instead.  With a half-life the order is by
    distance over decay; with ``text`` (and ``docs``: id, text) the pool is blended with BM25, after decay if both.
    """
    r = records
    if "flags" in r.columns:
        r = r.where(search.searchable(F.col("flags")))
    if namespace is not None:
        r = r.where(F.col("namespace_id") == namespace)
    if tag is not None:
        r = r.where(F.col("tag") == tag)
    if metadata and not pool:
        r = r.where(filters.matches(F.col("metadata"), metadata))
    n = search.overfetch(k, filtered=bool(metadata) and pool, rerank=text is not None, decay=half_life > 0) if (pool or text is not None or half_life > 0) else k
    keep = [c for c in ("metadata", "created_at") if c in r.columns]
    dist = fx.l2_squared(F.col("fx"), F.col("q"))
    hits = r.crossJoin(F.broadcast(query.limit(1))).select("id", dist.alias("distance"), *keep).orderBy("distance", "id").limit(n)
    if metadata and pool:
        hits = hits.where(filters.matches(F.col("metadata"), metadata))
    one = W.partitionBy(F.lit(0))  # the hits are a bounded pool
    f = search.decay_factor(F.col("created_at"), now, half_life) if half_life > 0 else F.lit(1.0)
    hits = hits.withColumn("adjusted", F.col("distance") / F.greatest(f, F.lit(1e-9))).withColumn("rank", F.row_number().over(one.orderBy("adjusted", "id")))
    if text is not None and docs is not None:
        best = bm25.hybrid(hits.select("id", F.col("adjusted").alias("distance"), "rank"), docs, text, k).select("id", "blended", "rank")
        out = hits.drop("rank").join(best, "id").withColumn("position", F.row_number().over(one.orderBy(F.desc("blended"), "rank")))
    else:
        out = hits.withColumn("position", F.col("rank")).where(F.col("position") <= k)
    return out.select("id", "distance", fx.score(F.col("distance")).alias("score"), *([c for c in keep if c == "metadata"]), "position")


def find_as_of(events: DataFrame, query: DataFrame, k: int, *, index: int | None = None, ts: int | None = None, namespace: int = 0) -> DataFrame:
    """Exact search in the state at a log index or a time; before the first event there is nothing."""
    past = log.as_of_index(events, index) if index is not None else log.as_of_time(events, ts or 0)
    return find(log.fold(past).records, query, k, namespace=namespace)


def event_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of b that a doesn't have, by log index."""
    return b.join(a.select("log_index"), "log_index", "left_anti")


def extract(chunks: DataFrame, matcher: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(id, name, kind) of the entities that a callable finds in each chunk (id, text); it may call any model."""

    def run(batches):
        for b in batches:
            rows = [(i, n, k) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, k in matcher(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "name", "kind"])

    return chunks.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, name string, kind string")


def dictionary_matcher(names: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """Finds the names of a small dictionary as whole words, whatever their case."""
    import re

    pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", re.I)
    lowered = {n.lower(): n for n in names}

    def match(text: str) -> list[tuple[str, str]]:
        found = sorted({lowered[m.group(1).lower()] for m in pattern.finditer(text)})
        return [(n, names[n]) for n in found]

    return match


def operation_receipt(operations: DataFrame) -> DataFrame:
    """(n, receipt) of operations (n, operation, graph, before, after, fragments): one hash over all, the fragments in order."""
    from .proofs import SEPARATOR

    return operations.select("n", F.sha2(F.concat_ws(SEPARATOR, F.sha2("operation", 256), F.sha2("graph", 256), "before", "after", F.array_join("fragments", ",")), 256).alias("receipt"))


def explain(df: DataFrame) -> dict:
    """What will run, as data: the physical plan's operators from the top, and whether adaptive execution may change it."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    names = [m[1] for line in plan.split("\n") if (m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line))]
    return {"operators": names, "adaptive": "AdaptiveSparkPlan" in plan}
