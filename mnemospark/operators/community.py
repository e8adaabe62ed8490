"""Communities: label propagation in id order, members, centroids, search and overview."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut, drop_cut
from .components import components as star_components


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node: the smallest id that can be reached over edges between nodes."""
    known = nodes.select("id")
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    found = star_components(links)
    return known.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def propagate(ids: list[int], links: list[tuple[int, int]], rounds: int = 20) -> dict[int, int]:
    """Labels after sweeps in id order that take effect at once: each node takes the label most frequent among its
    neighbours (the smallest of equals), a loop counting twice; until nothing changes or the rounds are over."""
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in links:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    label = {i: i for i in ids}
    for _ in range(rounds):
        changed = False
        for i in sorted(ids):
            if not near[i]:
                continue
            count: dict[int, int] = {}
            for j in near[i]:
                count[label[j]] = count.get(label[j], 0) + 1
            best = min(count, key=lambda c: (-count[c], c))
            changed, label[i] = changed or best != label[i], best
        if not changed:
            break
    return label


def detect(nodes: DataFrame, edges: DataFrame, rounds: int = 20, largest: int = 5_000_000, namespace: int | None = None) -> DataFrame:
    """(id, community).  Labels travel along edges only, so every connected component is settled on its own, many at
    once, by sweeps in id order.  A component of more than ``largest`` nodes and edges doesn't fit one task; its labels
    are settled by ``propagate_wide``.  A ``namespace`` other than 0 leaves the nodes of the others out."""
    if namespace:
        nodes = nodes.where(F.col("namespace_id") == namespace)
    comp = cut(components(nodes, edges), "components")
    own = edges.select("src", "dst").join(comp.select(F.col("id").alias("src"), "component"), "src").join(comp.select(F.col("id").alias("dst")), "dst", "left_semi")
    rows = comp.select("component", F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(own.select("component", F.col("src").alias("a"), F.col("dst").alias("b")))
    big = [r["component"] for r in rows.groupBy("component").count().where(F.col("count") > largest).collect()]  # few: each has over ``largest`` rows

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["b"].isna()
        links = list(zip(pdf["a"][~alone].astype("int64"), pdf["b"][~alone].astype("int64"), strict=True))
        out = propagate(pdf["a"][alone].astype("int64").tolist(), links, rounds)
        return pd.DataFrame({"id": list(out), "community": list(out.values())})

    small = rows.where(~F.col("component").isin(big)) if big else rows
    out = small.groupBy("component").applyInPandas(settle, "id long, community long")
    if big:
        wide = rows.where(F.col("component").isin(big))
        out = out.unionByName(propagate_wide(wide.where("b is null").select(F.col("a").alias("id")), wide.where("b is not null").select("a", "b"), rounds))
    return out


def propagate_wide(nodes: DataFrame, links: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community) of nodes (id) over links (a, b) by joins: in every round the even half of a hash of the ids takes
    the labels most frequent among its neighbours (the smallest of equals, a loop counting twice), then the odd half;
    until nothing changes or the rounds are over.  Halves in turn keep labels from swapping for ever."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    label = cut(nodes.select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        moved = 0
        for half in (0, 1):
            votes = both.where(F.pmod(F.xxhash64("a"), F.lit(2)) == half).join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
            best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("community")).alias("least"))).alias("v")).select(F.col("a").alias("id"), (-F.col("v.least")).alias("best"))
            now = cut(label.join(best, "id", "left").select("id", F.coalesce("best", "community").alias("community"), (F.coalesce("best", "community") != F.col("community")).alias("moved")), "labels")
            moved += now.where("moved").count()
            drop_cut(label)
            label = now
        if not moved:
            break
    return label.select("id", "community")


def centroids(assignments: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(community, members, centroid): the mean vector of the members' records, null without any."""
    vec = nodes.select("id", "record_id").join(records.select(F.col("id").alias("record_id"), "vec"), "record_id")
    part = assignments.join(vec, "id").select("community", F.posexplode("vec").alias("j", "x")).groupBy("community", "j").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = part.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("centroid"))
    sizes = assignments.groupBy("community").agg(F.count("*").alias("members"))
    return sizes.join(means, "community", "left")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)), F.lit(1e-9))
    return dot / (norm(a) * norm(b))


def search(store: DataFrame, query: DataFrame, k: int, assignments: DataFrame | None = None, sample: int = 20) -> DataFrame:
    """(community, similarity, members) of the k communities nearest to the query row (q), by similarity and id; with
    ``assignments`` also ``first``, the smallest ``sample`` member ids."""
    found = store.where("centroid is not null").crossJoin(F.broadcast(query.limit(1))).where(F.size("centroid") == F.size("q"))
    sim = cosine(F.col("centroid"), F.transform("q", lambda x: x.cast("double")))
    top = found.select("community", sim.alias("similarity"), "members").orderBy(F.desc("similarity"), "community").limit(k)
    if assignments is None:
        return top
    first = overview(assignments.join(F.broadcast(top.select("community")), "community", "left_semi"), sample).select("community", "first")
    return top.join(first, "community", "left").orderBy(F.desc("similarity"), "community")


def overview(assignments: DataFrame, sample: int = 10) -> DataFrame:
    """(community, members, first): the sizes, largest first, with the smallest ``sample`` member ids.

    Members are ranked with a group limit, so a large community keeps ``sample`` rows a task."""
    sizes = assignments.groupBy("community").agg(F.count("*").alias("members"))
    ranked = assignments.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("id"))).where(F.col("r") <= sample)
    first = ranked.groupBy("community").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first"))
    return sizes.join(first, "community").orderBy(F.desc("members"), "community")


def receipt(assignments: DataFrame) -> DataFrame:
    """One row: the digest over (node, community) in node order, by digests of ranges so that no task sorts all."""
    part = assignments.groupBy(F.floor(F.col("id") / 100_000).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "community"))), lambda s: F.concat_ws(":", s["id"], s["community"])), ","), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda s: s["h"]), ""), 256).alias("receipt"))
