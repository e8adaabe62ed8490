"""BM25 statistics, postings and the hybrid rerank of vector hits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values of the scoring formula
K1, B = 1.5, 0.75
VECTOR_SHARE = 0.5


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least two bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of (id, text); counted in each task before the shuffle."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, total, avgdl) of (id, text)."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, total): in how many rows of (id, text) a term stands, and how often; one shuffle, counted in each task
    before it.  In a row's sorted terms the first of equals stands for the row."""
    ordered = docs.select(F.array_sort(tokens(F.col("text"))).alias("t"))
    each = ordered.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("term"), (~x.eqNullSafe(F.when(i > 0, F.get(F.col("t"), i - 1)))).cast("long").alias("first")))).alias("e"))
    return each.groupBy("e.term").agg(F.sum("e.first").alias("df"), F.count("*").alias("total"))


def scores(docs: DataFrame, query: DataFrame) -> DataFrame:
    """(id, bm25) over the whole corpus for the query's terms (term, times); repeated query terms count repeatedly.

    The terms of a query are few: they go into the plan, each text is reduced to them in its own row, one pass brings
    the corpus' statistics (a number a term), a second one the scores.  Rows under one id add up.
    """
    terms = sorted((r["term"], r["times"]) for r in query.groupBy("term").agg(F.sum("times").alias("times")).collect())
    names = [t for t, _ in terms]
    if not terms:
        return docs.select("id", F.lit(None).cast("double").alias("bm25")).where(F.lit(False))
    # what a lambda binds is computed once a row
    once = lambda x, fn: F.element_at(F.transform(F.array(x), fn), 1)
    text = tokens(F.col("text"))
    told = once(text, lambda t: F.array_prepend(F.transform(F.array(*map(F.lit, names)), lambda x: F.array_contains(t, x).cast("long")), F.size(t).cast("long")))
    sums = docs.select(F.posexplode(told).alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("x")).collect()  # a row a term and one more
    n, total = next(((r["n"], r["x"]) for r in sums if r["i"] == 0), (0, 0))
    df = [next((r["x"] for r in sums if r["i"] == i + 1), 0) for i in range(len(names))]
    weights = [(x, times * max(0.0, math.log((n - c + 0.5) / (c + 0.5) + 1))) for (x, times), c in zip(terms, df, strict=True)]

    def scored(d: Column) -> Column:
        def part(w: Column) -> Column:
            tf = F.size(F.filter(d["q"], lambda x: x == w["term"]))
            return w["weight"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * d["dl"] / max(total / max(n, 1), 1e-9)))

        return F.when(F.size(d["q"]) > 0, F.aggregate(F.array(*(F.struct(F.lit(x).alias("term"), F.lit(w).alias("weight")) for x, w in weights)), F.lit(0.0), lambda s, w: s + part(w)))

    hits = once(text, lambda t: F.struct(F.size(t).alias("dl"), F.filter(t, lambda x: x.isin(names)).alias("q")))
    own = docs.select("id", once(hits, scored).alias("bm25")).where("bm25 is not null")
    return own.groupBy("id").agg(F.sum("bm25").alias("bm25"))


def query_terms(spark, text: str) -> DataFrame:
    """(term, times) of a query string."""
    return spark.range(1).select(F.explode(tokens(F.lit(text))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


def _minmax(x: Column, w) -> Column:
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((x - low) / (high - low))


def hybrid(hits: DataFrame, docs: DataFrame, query: str, k: int) -> DataFrame:
    """(id, distance, bm25, blended) of vector hits (id, distance, rank), half by distance and half by BM25.

    The statistics are those of the whole corpus.  Hits without text score 0; a query without tokens leaves the order.
    """
    terms = query_terms(hits.sparkSession, query)
    found = hits.join(scores(docs, terms), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    every = W.partitionBy(F.lit(0))  # the hits are a bounded pool
    blended = VECTOR_SHARE * (1 - _minmax(F.col("distance"), every)) + (1 - VECTOR_SHARE) * _minmax(F.col("bm25"), every)
    out = found.withColumn("blended", blended)
    if terms.isEmpty():
        return out.orderBy("rank").limit(k)
    return out.orderBy(F.desc("blended"), "rank").limit(k)
