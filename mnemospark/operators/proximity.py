"""Approximate search in layered proximity graphs, one per shard of records.

A graph is built by inserting records one after another, so a table is dealt into shards of bounded size, each built in
one task; a query visits the shards of the cells nearest to it, as many as a sample shows to be needed, and the shards'
best are ranked together.  Levels come from a hash of the id and
ties go to the smaller id, so the graphs don't depend on partitions or time.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cells
from .cells import FNV_OFFSET, FNV_PRIME

# fixed values: links a node keeps above the ground and on it, and how far building and searching look
LINKS, GROUND_LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 32, 100, 50
SHARD_ROWS = 4000


def level(i: int) -> int:
    """How many layers above the ground a record reaches: geometric with ratio 1/16, from FNV-1a of its id."""
    h = FNV_OFFSET
    for b in (i & 0xFFFFFFFF).to_bytes(4, "little"):
        h = ((h ^ b) * FNV_PRIME) % (1 << 64)
    u = ((h >> 11) + 1) / float(1 << 53)
    return int(-math.log(min(u, 1.0)) / math.log(LINKS))


class Layers:
    """One shard's graph over rows of ``x`` (ids ascending)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.int64)
        self.links: list[dict[int, list[int]]] = []
        self.entry = -1

    def distance(self, q: np.ndarray, rows: list[int]) -> list[int]:
        d = self.x[rows] - q
        return np.einsum("ij,ij->i", d, d).tolist()

    def near(self, q: np.ndarray, start: list[tuple[int, int]], width: int, layer: int) -> list[tuple[int, int]]:
        """Up to ``width`` (distance, row) in a layer, nearest first, from some starting rows."""
        links = self.links[layer]
        seen = {r for _, r in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, -r) for d, r in start]
        heapq.heapify(best)
        while todo:
            d, r = heapq.heappop(todo)
            if len(best) >= width and (d, r) > (-best[0][0], -best[0][1]):
                break
            fresh = [k for k in links.get(r, ()) if k not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, k in zip(self.distance(q, fresh), fresh, strict=True):
                if len(best) < width or (e, k) < (-best[0][0], -best[0][1]):
                    heapq.heappush(todo, (e, k))
                    heapq.heappush(best, (-e, -k))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -r) for d, r in best)

    def choose(self, found: list[tuple[int, int]], most: int) -> list[int]:
        """Neighbours that lie nearer to the point than to any neighbour kept so far, filled up with the nearest others."""
        rows = [r for _, r in found]
        x = self.x[rows]
        square = np.einsum("ij,ij->i", x, x)
        between = square[:, None] + square[None, :] - 2 * (x @ x.T)
        nearest = np.full(len(rows), np.iinfo(np.int64).max)  # to what is kept so far
        kept: list[int] = []
        for i, (d, _) in enumerate(found):
            if len(kept) == most:
                break
            if nearest[i] > d:
                kept.append(i)
                np.minimum(nearest, between[i], out=nearest)
        own = set(kept)
        rest = [i for i in range(len(rows)) if i not in own]
        return [rows[i] for i in kept + rest[: most - len(kept)]]

    def insert(self, row: int) -> None:
        top = level(int(self.ids[row]))
        q = self.x[row]
        if self.entry < 0:
            self.links = [{row: []} for _ in range(top + 1)]
            self.entry = row
            return
        at = [(self.distance(q, [self.entry])[0], self.entry)]
        for layer in range(len(self.links) - 1, -1, -1):
            if layer > top:
                at = self.near(q, at, 1, layer)
                continue
            at = self.near(q, at, BUILD_WIDTH, layer)
            most = LINKS if layer else GROUND_LINKS
            own = self.choose(at, most)
            self.links[layer][row] = own
            for r in own:
                back = self.links[layer].setdefault(r, [])
                back.append(row)
                if len(back) > most:
                    ranked = sorted(zip(self.distance(self.x[r], back), back, strict=True))
                    self.links[layer][r] = self.choose(ranked, most)
        while len(self.links) <= top:
            self.links.append({row: []})
            self.entry = row

    def search(self, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        if self.entry < 0 or k <= 0:
            return []
        at = [(self.distance(q, [self.entry])[0], self.entry)]
        for layer in range(len(self.links) - 1, 0, -1):
            at = self.near(q, at, 1, layer)
        return self.near(q, at, max(k, SEARCH_WIDTH), 0)[:k]


@dataclass
class Graphs:
    """The graphs of all shards as a table (cell, shard, id, fx, layer, neighbours), one row per record and layer, the
    cells' centroids, and how many cells a query visits."""

    table: DataFrame
    centroids: np.ndarray
    probes: int


def build(records: DataFrame, shard_rows: int = SHARD_ROWS, target: float = cells.TARGET) -> Graphs:
    """Records are dealt into cells of like vectors, as many as give shards of about half of ``shard_rows``; a cell of
    more is dealt further into shards by a hash of the id.  Every shard is built in one task."""
    usable = records.where("fx is not null").select(F.col("id").cast("long"), "fx")
    n = usable.count()
    many = max(1, math.ceil(2 * n / shard_rows)) if n > shard_rows else 1
    index = cells.build(usable, many, iterations=10, target=target)
    placed = index.records
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cell", "shard", "id", "fx")  # one row a cell

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        g = Layers(ids, np.stack(pdf["fx"].to_list()))
        for row in range(len(ids)):
            g.insert(row)
        rows = [(pdf["cell"].iloc[0], pdf["shard"].iloc[0], int(ids[r]), pdf["fx"].iloc[r] if n == 0 else None, n, [int(ids[k]) for k in near]) for n, links in enumerate(g.links) for r, near in links.items()]
        return pd.DataFrame(rows, columns=["cell", "shard", "id", "fx", "layer", "neighbours"])

    table = dealt.groupBy("cell", "shard").applyInPandas(grow, "cell int, shard int, id long, fx array<int>, layer int, neighbours array<long>")
    return Graphs(table, index.centroids, index.probes)


def save(graphs: Graphs, path: str) -> None:
    """Write the graphs as one directory per cell, so a query reads those it visits only, and the centroids."""
    graphs.table.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/graphs")
    rows = [(i, [int(x) for x in c], graphs.probes) for i, c in enumerate(graphs.centroids)]
    graphs.table.sparkSession.createDataFrame(rows, "cell int, centroid array<long>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> Graphs:
    told = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    table = spark.read.schema("shard int, id long, fx array<int>, layer int, neighbours array<long>, cell int").parquet(f"{path}/graphs")
    return Graphs(table, np.array([r["centroid"] for r in told], np.int64) if told else np.zeros((0, 0), np.int64), told[0]["probes"] if told else 1)


def search(graphs: Graphs, queries: DataFrame, k: int, query_bytes: int = 16 << 20) -> DataFrame:
    """(qid, id, dist, rank): each query (qid, q) in the shards of the cells it visits, ranked together; the queries are
    broadcast in blocks of bounded bytes."""
    m = min(graphs.probes, max(1, len(graphs.centroids)))
    size = queries.agg(F.sum(F.size("q") * 4 + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size * m / query_bytes))
    spark, out = graphs.table.sparkSession, None
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)
        asked: dict[int, list] = {}
        for r in cells.routes(own, graphs.centroids, m).where(F.col("cell") != cells.UNPLACED).collect():
            asked.setdefault(r["cell"], []).append((r["qid"], r["q"]))
        if not asked:
            continue
        visited = spark.createDataFrame([(c,) for c in asked], "cell int")
        shared = spark.sparkContext.broadcast(asked)
        part = graphs.table.join(F.broadcast(visited), "cell").groupBy("cell", "shard").applyInPandas(_visitor(shared, k), "qid long, id long, dist long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, dist long, rank int")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "id"))).where(F.col("rank") <= k)


def _visitor(shared, k: int):
    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        ground = pdf[pdf["layer"] == 0].sort_values("id")
        ids = ground["id"].to_numpy()
        g = Layers(ids, np.stack(ground["fx"].to_list()))
        place = {int(i): r for r, i in enumerate(ids)}
        top = int(pdf["layer"].max())
        g.links = [{} for _ in range(top + 1)]
        for r in pdf.itertuples():
            g.links[r.layer][place[r.id]] = [place[int(x)] for x in r.neighbours]
        g.entry = min(g.links[top])
        rows = [(qid, int(ids[r]), d) for qid, q in shared.value[int(pdf["cell"].iloc[0])] for d, r in g.search(np.array(q, np.int64), k)]
        return pd.DataFrame(rows, columns=["qid", "id", "dist"])

    return visit
