"""Section trees of markdown documents: building, ranking, answers, receipts and the blend with vector hits.

Nodes are (doc_id, node_id, title, level, start_line, end_line, own_text, summary, parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunking import trim

# fixed values: words that don't count in a section query
STOPWORDS = (
    "the a an and or of to in on for is are do does i you my our how what when where which can may get much many per with at be if it this that as by from have has"
).split()
TITLE, SUMMARY, BODY_MOST, LEVEL = 5.0, 2.0, 3, 0.1
SUMMARY_CHARS, TREE_SHARE = 160, 0.6
SEPARATOR, GENESIS = "\x1f", "0" * 64


def terms(text: Column) -> Column:
    """ASCII letters and digits, lower case, at least two, no stopwords; in order, with repeats."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def first_sentence(text: Column) -> Column:
    """Up to the first . ! or ? of the lines that aren't empty, at most 160 characters; null if there is nothing."""
    body = F.array_join(F.filter(F.split(text, "\n"), lambda l: trim(l) != ""), " ")
    return F.when(body != "", trim(F.substring(F.regexp_extract(body, r"(?s)\A([^.!?]*[.!?]?)", 1), 1, SUMMARY_CHARS)))


def build(docs: DataFrame) -> DataFrame:
    """The nodes of every document's headers (# to ######, a space, a title), outside code fences.

    A node's parent is the last header before it of a lower level: the latest of the last headers of each such level.
    """
    by = W.partitionBy("doc_id").orderBy("i")
    l = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("s", trim(F.col("line")))
    l = l.withColumn("fence", F.col("s").startswith("```").cast("int")).withColumn("inside", F.sum("fence").over(by) % 2 == 1)
    header = F.regexp_extract("s", r"(?s)^(#{1,6}) +(\S.*)$", 1)
    l = l.withColumn("level", F.when(~F.col("inside") & (F.col("fence") == 0) & (F.length(header) > 0), F.length(header)))
    l = l.withColumn("n", F.sum(F.col("level").isNotNull().cast("int")).over(by)).withColumn("total", F.max("i").over(W.partitionBy("doc_id")) + 1).where("n > 0")
    lines = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("i", "line"))))
    g = l.groupBy("doc_id", "n", "total").agg(
        F.max("level").alias("level"), F.min("i").alias("i"), F.max(F.when(F.col("level").isNotNull(), trim(F.regexp_extract("s", r"(?s)^#{1,6} +(\S.*)$", 1)))).alias("title"), trim(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("own_text")
    )
    own = W.partitionBy("doc_id").orderBy("n")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("n"))).over(before) for k in range(1, 6)]
    parent = F.coalesce(*(F.when(F.col("level") == k, F.greatest(*(F.coalesce(x, F.lit(0)) for x in [*last[: k - 1], F.lit(0), F.lit(0)]))) for k in range(2, 7)), F.lit(0))
    g = g.withColumn("parent_n", parent).withColumn("next", F.lead("i").over(own))
    name = lambda n: F.lpad(n.cast("string"), 4, "0")
    return g.select(
        "doc_id", name(F.col("n")).alias("node_id"), "title", F.col("level").cast("int"), (F.col("i") + 1).cast("int").alias("start_line"), F.coalesce(F.col("next"), F.col("total")).cast("int").alias("end_line"), "own_text",
        F.coalesce(first_sentence(F.col("own_text")), F.col("title")).alias("summary"), F.when(F.col("parent_n") > 0, name(F.col("parent_n"))).alias("parent"),
    )


def rank(nodes: DataFrame, query: str) -> DataFrame:
    """(doc_id, node_id, score) of the nodes that share terms with the query, best first, then by document and node."""
    q = F.array_sort(F.array_distinct(terms(F.lit(query))))
    body = terms(F.col("own_text"))
    n = nodes.select("doc_id", "node_id", "level", F.array_distinct(terms(F.col("title"))).alias("t"), F.array_distinct(terms(F.col("summary"))).alias("s"), body.alias("b"), q.alias("q"))

    def points(x: Column) -> Column:
        times = F.size(F.filter("b", lambda y: y == x))
        return F.when(F.array_contains("t", x), TITLE).otherwise(0.0) + F.when(F.array_contains("s", x), SUMMARY).otherwise(0.0) + F.least(times, F.lit(BODY_MOST)).cast("double")

    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + points(x))
    scored = n.withColumn("total", total).where("total > 0")
    return scored.select("doc_id", "node_id", F.round(F.col("total") + LEVEL * F.col("level"), 2).alias("score")).orderBy(F.desc("score"), "doc_id", "node_id")


def rank_normalised(ranked: DataFrame) -> DataFrame:
    """Scores over the best of each document."""
    return ranked.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("doc_id")))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, breadcrumb): titles from the root down.  Levels are at most six, so five steps reach any root."""
    out = nodes.select("doc_id", "node_id", F.col("title").alias("breadcrumb"), F.col("parent").alias("up"))
    step = nodes.select("doc_id", F.col("node_id").alias("up"), F.col("title").alias("above"), F.col("parent").alias("higher"))
    for _ in range(5):
        out = out.join(step, ["doc_id", "up"], "left").select("doc_id", "node_id", F.when(F.col("above").isNotNull(), F.concat_ws(" > ", "above", "breadcrumb")).otherwise(F.col("breadcrumb")).alias("breadcrumb"), F.col("higher").alias("up"))
    return out.select("doc_id", "node_id", "breadcrumb")


def answer(nodes: DataFrame, query: str, k: int = 3) -> DataFrame:
    """(doc_id, rank, node_id, score, breadcrumb, start_line, end_line, evidence) of each document's k best sections."""
    r = rank(nodes, query).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= k)
    text = nodes.select("doc_id", "node_id", "start_line", "end_line", F.col("own_text").alias("evidence"))
    return r.join(text, ["doc_id", "node_id"]).join(breadcrumbs(nodes), ["doc_id", "node_id"]).select("doc_id", "rank", "node_id", "score", "breadcrumb", "start_line", "end_line", "evidence")


def blend(sections: DataFrame, hits: DataFrame, k: int, share: float = TREE_SHARE) -> DataFrame:
    """(source, id, score): the best 2k sections (id, score) and 2k vector hits (id, distance) on one scale, best k."""
    a = sections.orderBy(F.desc("score"), "id").limit(2 * k)
    b = hits.orderBy("distance", "id").limit(2 * k)
    top, far = a.agg(F.max("score").alias("top")), b.agg(F.max("distance").alias("far"))
    a = a.crossJoin(F.broadcast(top)).select(F.lit("tree").alias("source"), F.col("id").cast("string").alias("id"), (share * F.col("score") / F.col("top")).alias("score"))
    near = F.greatest(F.least(1 - F.try_divide(F.col("distance").cast("double"), F.col("far").cast("double")), F.lit(1.0)), F.lit(0.0))
    b = b.crossJoin(F.broadcast(far)).select(F.lit("vector").alias("source"), F.col("id").cast("string").alias("id"), ((1 - share) * F.coalesce(near, F.lit(1.0))).alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "source", "id").limit(k)
