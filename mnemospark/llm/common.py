"""Shared helpers: Arrow mapping, checkpoint tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.lineage import cut, drop_cut, shared_folder  # noqa: F401

#: A side of a join is broadcast only when its counted rows times their width stay below this.
BROADCAST_LIMIT_BYTES = 32 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Batches are handed on in slices of about so many bytes, so that a worker's memory doesn't follow the batch size.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of bounded bytes, or one row where that is larger; empty batches are left out."""
    for b in batches:
        rows = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


#: Rows that Spark hands to a worker at once.  Its own default of 10,000 whole texts has no bound in bytes.
ROWS_PER_BATCH, _ROWS_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy() -> None:
    """Give what a partition has left in a reused worker back to the system: remembered hashes, Arrow's and malloc's pools."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of few rows (the session's setting is lowered to that), tidied up behind each partition."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_ROWS_KEY)) <= ROWS_PER_BATCH:
        spark.conf.set(_ROWS_KEY, str(ROWS_PER_BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, columns: Sequence[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the named columns only; other columns are pruned from the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return map_batches(df.select(*[F.col(f"`{c}`") for c in columns]), run, schema)


def row_key(*columns: str) -> Column:
    """A 128-bit name, as text, for a row where ids may be null or repeat; null differs from every value."""
    return F.md5(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)))))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null read as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted size is within the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound that keeps a worker's memory level."""

    def __init__(self, bound: int = 50_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """The words' 64-bit hashes."""
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


HOT, SALTS = 1000, 64


def heavy_keys(keys: DataFrame, key: str) -> list:
    """The keys with over a thousandth of all rows (column c); there are fewer than a thousand, however large the table."""
    total = keys.agg(F.sum("c")).first()[0] or 0
    return [r[0] for r in keys.where(F.col("c") > max(total // HOT, 2000)).select(key).distinct().collect()]


def deal(rows: DataFrame, key: str, heavy: list, by: Column) -> DataFrame:
    """The rows with a column salt, by which those of heavy keys are spread."""
    return rows.withColumn("salt", F.when(F.col(key).isin(heavy), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int") if heavy else F.lit(0))


def over_salts(keys: DataFrame, key: str, heavy: list) -> DataFrame:
    """The other side of a join with rows that were dealt: heavy keys stand under every salt."""
    one = F.array(F.lit(0))
    return keys.withColumn("salt", F.explode(F.when(F.col(key).isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(one) if heavy else one))


def salted(rows: DataFrame, keys: DataFrame, on: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``on`` and ``salt``: heavy keys (by their row counts in column c) are spread by column ``by``."""
    heavy = heavy_keys(keys, on[-1])
    return deal(rows, on[-1], heavy, F.col(by)), over_salts(keys, on[-1], heavy).drop("c")


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    a, b = salted(rows, keys, on, by)
    return a.join(b, [*on, "salt"], how).drop("salt")


def key_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with one key, and where each begins, from batches sorted by it."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        k = rest.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        if edges.size:
            yield rest.slice(0, int(edges[-1])).combine_chunks(), np.concatenate(([0], edges))
            rest = rest.slice(int(edges[-1])).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])
