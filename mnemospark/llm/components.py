"""Connected components: links are joined in tasks of bounded size first, what is left as the package's operators do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components as star_components
from .common import cut, drop_cut, map_batches

__all__ = ["components"]

#: A task joins so many links at once; with 2,097,152 different ids that took 137 MB.
TASK_LINKS = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the links, the smallest id that each reaches)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(ids.size)
    while True:
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        apart = high != low
        if not apart.any():
            return ids, ids[label]
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _joined(batches):
    """The links of a partition as links to the smallest id, TASK_LINKS at a time; every id also with itself or a smaller one."""

    def told(held):
        a, b = (np.concatenate([t.column(k).to_numpy() for t in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_reached(a, b)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        for t in (batch.slice(k, TASK_LINKS) for k in range(0, batch.num_rows, TASK_LINKS)):
            if n + t.num_rows > TASK_LINKS:
                yield told(held)
                held, n = [], 0
            held.append(t)
            n += t.num_rows
    if held:
        yield told(held)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that can be reached.

    Self-links are ignored; nulls are dropped; an id without links does not appear.
    """
    plain = cut(links.where("a <> b").select("a", "b"), "links")
    tasks = max(1, -(-plain.count() // TASK_LINKS))
    joined = cut(map_batches(plain.coalesce(tasks), _joined, "a long, b long"), "joined")
    drop_cut(plain)
    if tasks == 1:  # all links met
        return joined.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star_components(joined)
