"""Substring deduplication by relative Lempel-Ziv factors.

The reference is all documents, dealt in pieces to blocks by seed.  A seed is the smallest of the hashed
``seed_words``-grams of a window of ``window`` words, so equal windows anywhere have the same seed at the same place in
them.  Neighbouring windows with one seed are a run; the words that they cover are a piece of reference, and every
window lies in exactly one piece.

1. Seeds that stand in one place only can't belong to a repeated window; the other runs make up the reference.
2. Equal pieces of a seed are counted first.  One that stands in several places is a factor as a whole.
3. Different pieces go to their seed's block, which gets a suffix index.  Every piece that stands once is factored
   greedily against the block: at each place the longest match elsewhere in it, then on behind it.  All windows in a
   factor of ``window`` words or more are repeated; windows over a boundary between factors are looked up by themselves,
   as they may match elsewhere than both.
4. A document's repeated windows, joined where they overlap, are its duplicate spans (at least ``window`` words long).

A block is gathered from whole seeds until it has ``BLOCK_WORDS`` words.  A seed of more than ``PIECES`` different pieces
would be a block without bound; the windows of its pieces are grouped by their hash instead, which finds the same.
Counts are combined before shuffles, so a passage that stands in a third of all documents is one row per task.  The
texts are shuffled once; Spark reuses that exchange for the second join.

Defined results: a null or empty text has no words and no spans; documents of fewer than ``window`` words keep all;
repeated rows count as documents that equal each other; null ids are allowed.  Seeds and whole pieces are compared by
64-bit hashes, words in a block by 32 bits each: unequal windows pass for equal only if all words that differ collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, deal, drop_cut, heavy_keys, key_groups, map_batches, mix, over_salts, salted_join, slices, texts_of, word_hashes

WINDOW, SEED = 35, 8
#: Words of reference pieces that are indexed at once; different pieces of one seed that a block takes; runs whose words
#: a task remembers to have told.
BLOCK_WORDS, PIECES, TOLD = 400_000, 6000, 200_000
_P = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64."""
    up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Windows:
    """The runs of windows of one document's words."""

    def __init__(self, words: list[bytes], window: int = WINDOW, seed: int = SEED):
        self.n, self.window = len(words), window
        self.starts = np.empty(0, np.int64)
        if self.n < window:
            return
        h = mix(word_hashes(words))
        self.words = (h >> np.uint64(32)).astype(np.uint32)
        up, self.down = _powers(self.n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1])))
        grams = mix(self.span(np.arange(self.n - seed + 1), seed))
        value, at = grams, np.arange(grams.size)
        size, most = 1, window - seed + 1  # leftmost smallest gram of each window, by doubling
        while size < most:
            step = min(size, most - size)
            right = value[step:] < value[:-step]
            value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
            size += step
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.starts, self.seeds = first, value[first]  # a run's first window and its seed
        self.ends = np.concatenate((first[1:], [at.size]))
        self.offset = at[first] - first  # of the seed in the run's first window

    def span(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the words [start, start + length)."""
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def run_hashes(self, runs: np.ndarray) -> np.ndarray:
        """Of all words that the runs' windows cover, and where the seed stands among them."""
        a, size = self.starts[runs], self.ends[runs] - self.starts[runs]
        return mix(self.span(a, size + self.window - 1) + mix((size.astype(np.uint64) << np.uint64(32)) + self.offset[runs].astype(np.uint64)))

    def pieces(self, runs: np.ndarray) -> list[bytes]:
        """The words that each run's windows cover, 32 bits a word."""
        return [self.words[a : z + self.window - 1].tobytes() for a, z in zip(self.starts[runs].tolist(), self.ends[runs].tolist(), strict=True)]


class Reference:
    """A block of reference pieces under a suffix index.

    Suffixes are ranked by prefix doubling; behind every piece stands a word of its own, so no match reaches over its
    end.  The longest match of a place with any other place of the block is that with a neighbour in suffix order.
    """

    def __init__(self, pieces: list[np.ndarray]):
        self.sizes = np.array([p.size for p in pieces], np.int64)
        self.begin = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        n = int(self.sizes.sum()) + len(pieces)
        text = np.zeros(n, np.uint64)
        for p, a in zip(pieces, self.begin.tolist(), strict=True):
            text[a : a + p.size] = p
        text[self.begin + self.sizes] = (np.uint64(1) << np.uint64(32)) + np.arange(len(pieces), dtype=np.uint64)
        rank = np.unique(text, return_inverse=True)[1].astype(np.uint64)
        ranks, step = [rank], 1
        while step <= self.sizes.max(initial=0):
            right = np.zeros(n, np.uint64)
            right[:-step] = rank[step:] + np.uint64(1)
            rank = np.unique(rank * np.uint64(n + 1) + right, return_inverse=True)[1].astype(np.uint64)
            ranks.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(a.size, np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # how many words neighbours have in common, by halving
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            common[inside] += np.where(ranks[k][x[inside]] == ranks[k][y[inside]], 1 << k, 0)
        self.longest = np.zeros(n, np.int64)
        np.maximum.at(self.longest, a, common)
        np.maximum.at(self.longest, b, common)

    def factors(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, words) of the greedy parse of the pieces: always the longest match, or one word without any."""
        out: tuple[list, list, list] = ([], [], [])
        at, piece = np.zeros(of.size, np.int64), of
        while piece.size:
            size = np.maximum(self.longest[self.begin[piece] + at], 1)
            for column, v in zip(out, (piece, at, size), strict=True):
                column.append(v)
            at = at + size
            left = at < self.sizes[piece]
            piece, at = piece[left], at[left]
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)

    def repeated(self, of: np.ndarray, window: int) -> list[int]:
        """For each of the pieces a mask of its windows that stand elsewhere in the block too."""
        piece, start, size = self.factors(of)
        edge = np.zeros(self.longest.size + 1, np.int64)
        long = size >= window
        np.add.at(edge, self.begin[piece[long]] + start[long], 1)
        np.add.at(edge, self.begin[piece[long]] + start[long] + size[long] - window + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0  # all windows of a long factor
        out = []
        for p in of.tolist():
            a, m = int(self.begin[p]), int(self.sizes[p]) - window + 1
            own = inside[a : a + m]
            # what is left lies over a boundary between factors and is looked up by itself
            boundary = np.flatnonzero(~own)
            own[boundary] = self.longest[a + boundary] >= window
            out.append(int(np.dot(own.astype(np.int64), np.int64(1) << np.arange(m))))
        return out


def split_words(text: str) -> list[bytes]:
    return text.encode().split()  # at the bytes 9 to 13 and 32


def duplicate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list]:
    """(rid, runs) for each document with repeated windows, the documents under their rid, and the rids of very many rows.

    A run is (id, start, size, mask): bit k of mask says that the window of words from start + k on stands elsewhere.
    """
    kind = dict(docs.dtypes)[id_col]
    parts = [x for c in (id_col, text_col) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    keyed = docs.select(F.xxhash64(*parts).alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`") for c in carry))

    def seeds(batches):
        for b in slices(batches):
            rid = b.column(0).to_numpy()
            out, who = [], []
            for r, t in zip(rid, texts_of(b), strict=True):
                w = Windows(split_words(t), window, seed)
                if w.starts.size:
                    out.append(w.seeds)
                    who.append(np.full(w.seeds.size, r, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who))], names=["seed", "rid"])

    found = cut(map_batches(keyed.select("rid", "text"), seeds, "seed long, rid long"), "found")
    repeated = cut(found.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1"), "seeds")
    wanted = cut(salted_join(found, repeated, ["seed"], "rid", "left_semi").groupBy("rid").agg(F.collect_set("seed").alias("seeds"), F.count("*").alias("c")), "wanted")
    drop_cut(found)
    heavy = heavy_keys(wanted, "rid")  # rows that repeat, or texts of very many runs
    dealt = deal(keyed, "rid", heavy, F.spark_partition_id())
    placed = dealt.join(over_salts(wanted.drop("c"), "rid", heavy), ["rid", "salt"])

    def runs(batches):
        told: set[int] = set()
        for b in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            pieces, row = [], []
            rids, wants = b.column(0).to_numpy(), b.column(3)
            for i, t in enumerate(texts_of(b)):
                w = Windows(split_words(t), window, seed)
                own = np.sort(np.asarray(wants[i].values.to_numpy(zero_copy_only=False)).view(np.uint64))
                if not own.size or not w.starts.size:
                    continue
                at = np.searchsorted(own, w.seeds)
                take = np.flatnonzero(own[np.minimum(at, own.size - 1)] == w.seeds)
                if take.size:
                    run = w.run_hashes(take)
                    for column, v in zip(columns, (w.seeds[take], run, w.starts[take], w.ends[take] - w.starts[take], np.full(take.size, rids[i])), strict=True):
                        column.append(v)
                    if len(told) > TOLD:
                        told.clear()
                    for h, p in zip(run.tolist(), w.pieces(take), strict=True):  # a task tells a run's words once
                        pieces.append(None if h in told else p)
                        told.add(h)
                    row.append(np.full(take.size, i))
            if row:
                seed_, run, start, size, rid = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed_.view(np.int64)), pa.array(run.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(rid.astype(np.int64)), b.column(1).take(pa.array(np.concatenate(row))), pa.array(pieces, pa.binary())],
                    names=["seed", "run", "start", "size", "rid", "id", "words"],
                )

    schema = f"seed long, run long, start int, size int, rid long, id {kind}, words binary"
    placed_runs = cut(map_batches(placed.select("rid", "id", "text", "seeds"), runs, schema), "runs")
    different = cut(placed_runs.groupBy("seed", "run").agg(F.count("*").alias("copies")), "different")
    several = different.groupBy("seed").agg(F.count("*").alias("runs"), F.sum("copies").alias("c")).where("runs > 1")
    told = placed_runs.where("words is not null").select("seed", "run", "words", "rid")
    pieces = salted_join(told, cut(several, "several"), ["seed"], "rid").dropDuplicates(["seed", "run"]).select("seed", "run", "words", "runs").join(different, ["seed", "run"])
    pieces = cut(pieces, "pieces")

    def parse(batches):
        at_once: list = []
        words = 0
        for t, _ in key_groups(batches, 0):
            at_once.append(t)
            words += t.column(2).nbytes // 4
            if words >= BLOCK_WORDS:
                yield from _parsed(pa.concat_tables(at_once), window)
                at_once, words = [], 0
        if at_once:
            yield from _parsed(pa.concat_tables(at_once), window)

    blocks = pieces.where(F.col("runs") <= PIECES).select("seed", "run", "words", "copies").repartition("seed").sortWithinPartitions("seed")
    factored = map_batches(blocks, parse, "seed long, run long, mask long")

    def single_windows(batches):
        for b in slices(batches):
            if b.num_rows:
                hashes, sizes = [], []
                for p in b.column(2).to_pylist():
                    h = mix(np.frombuffer(p, np.uint32).astype(np.uint64))
                    up, down = _powers(h.size)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1])))
                    m = h.size - window + 1
                    hashes.append(mix((sums[window:] - sums[:m]) * down[:m]))
                    sizes.append(m)
                take = np.repeat(np.arange(b.num_rows), sizes)
                k = np.concatenate([np.arange(m) for m in sizes])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(take)) for i in (0, 1, 3)), pa.array(k.astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=["seed", "run", "copies", "k", "w"])

    # a seed with more different runs than a block takes: window by window, which needs no group in one place
    single = map_batches(pieces.where(F.col("runs") > PIECES).select("seed", "run", "words", "copies"), single_windows, "seed long, run long, copies long, k int, w long")
    equal = single.groupBy("seed", "w").agg(F.sum("copies").alias("c")).where("c > 1").select("seed", "w")
    one_by_one = single.where("copies = 1").join(equal, ["seed", "w"], "left_semi").groupBy("seed", "run").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).alias("mask"))
    boundary = factored.unionByName(one_by_one).select("seed", "run", "mask", F.lit(1).cast("long").alias("c"))
    whole = different.where("copies > 1").select("seed", "run", F.lit(-1).cast("long").alias("mask"), F.col("copies").alias("c"))
    masks = cut(whole.unionByName(boundary), "masks")
    matched = salted_join(placed_runs.select("seed", "run", "start", "size", "rid", "id"), masks, ["seed", "run"], "rid")
    return matched.groupBy("rid").agg(F.collect_set(F.struct("id", "start", "size", "mask")).alias("runs")), dealt, heavy


def _parsed(block: pa.Table, window: int):
    """(seed, run, mask) of the block's pieces that stand once and have windows that stand elsewhere too."""
    single = np.flatnonzero(block.column(3).to_numpy() == 1)
    if not single.size:
        return
    masks = Reference([np.frombuffer(p, np.uint32) for p in block.column(2).to_pylist()]).repeated(single, window)
    hit = [i for i, m in enumerate(masks) if m]
    if hit:
        at = pa.array(single[hit])
        yield pa.RecordBatch.from_arrays([block.column(0).combine_chunks().take(at), block.column(1).combine_chunks().take(at), pa.array([masks[i] for i in hit], pa.int64())], names=["seed", "run", "mask"])


def removed_words(n_words: int, starts, sizes, masks, window: int = WINDOW) -> np.ndarray:
    """True for the words that a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, size, mask in zip(starts, sizes, masks, strict=True):
        for k in range(size):
            if mask >> k & 1:
                edge[start + k] += 1
                edge[start + k + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per input row: id, n_words, n_removed, the digest of the kept words (with ``keep`` the kept text), and ``carry``.

    The kept text of a document without removals is its text unchanged; otherwise the kept words joined by one space.
    """
    if window - seed + 1 > 62:
        raise ValueError("a run's mask holds at most 62 windows")
    kind = dict(docs.dtypes)[id_col]
    found, dealt, heavy = duplicate_spans(docs, id_col=id_col, text_col=text_col, window=window, seed=seed, carry=carry)
    joined = dealt.join(over_salts(found, "rid", heavy), ["rid", "salt"], "left").select("rid", "id", "text", "runs", *carry)
    kinds = dict(joined.dtypes)

    def finish(batches):
        for b in slices(batches):
            ids, runs = b.column(1), b.column(3).to_pylist()
            raw, texts = b.column(2).to_pylist(), texts_of(b)
            own = ids.to_pylist()
            n, gone, out = [], [], []
            for i, t in enumerate(texts):
                words = split_words(t)
                r = [x for x in runs[i] or () if x["id"] == own[i]]
                n.append(len(words))
                if r:
                    cover = removed_words(len(words), *([x[k] for x in r] for k in ("start", "size", "mask")), window)
                    gone.append(int(cover.sum()))
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                else:
                    gone.append(0)
                kept = b" ".join(words)
                out.append((raw[i] if not r else kept.decode()) if keep else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()), *(b.column(4 + k) for k in range(len(carry)))], names=[id_col, "n_words", "n_removed", "kept" if keep else "kept_sha256", *carry]
            )

    tail = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return map_batches(joined, finish, f"`{id_col}` {kind}, n_words long, n_removed long, {'kept' if keep else 'kept_sha256'} string{tail}")
