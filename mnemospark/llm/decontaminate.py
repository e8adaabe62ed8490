"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The items are the documents of the index, the training passages its queries.  Every training text is cut into passages
of twice the longest item, each overlapping the next by half, so that a whole item lies inside one of them.  An item's
score is divided by the score that the item itself would get, so one threshold serves all items.  For a passage and
a group of neighbouring items, the sum of the terms' largest impacts in the group is an upper bound; passages that
reach the threshold in some group run block-max WAND over the postings (sorted by item, in blocks that know their
largest impact) and retrieve all items at or above it.  A retrieved pair is verified: enough word trigrams of the
item's question and of its answer stand in the passage.

The index is built in blocks of bounded bytes, each broadcast on its own; document frequencies and the average length
come from all items.  Training texts are never shuffled.  Pairs are found per document, so nothing grows with groups.

Defined results: only verified pairs are returned, one row per document row and item (its best passage); null and
empty texts and items give none; repeated rows give their rows each.  Items of fewer than ``LEAST`` words are not
ranked: the whole item must stand in the text, word behind word (its first place is told, all scores are 1).  A
character of a script without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) counts as a word.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, texts_of

K1, B = 1.2, 0.75
LEAST, BLOCK, GROUPS = 8, 4, 64
#: Words as they are written whose numbers a worker remembers.
SEEN = 50_000
_SPLIT = re.compile(r"(?is)^(.*?)(?:\banswer\s*:|\ba\s*:(?=\s)|(?<=\?))\s*(\S.*)$")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_/\\`~^=+"


def term(word: str) -> str:
    """Lower case without punctuation at the edges."""
    return word.lower().strip(_EDGE)


def split(text: str) -> list[str]:
    """Words between white space, and each character of a script without spaces."""
    return text.split() if text.isascii() or not _UNSPACED.search(text) else _UNSPACED.sub(r" \1 ", text).split()


def terms(text: str) -> list[str]:
    return [t for t in map(term, split(text)) if t]


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` term numbers."""
    h = np.zeros(ids.size - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + h.size].astype(np.uint64) + np.uint64(2)
    return h


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's parts: at an answer mark or a question mark, else its two halves."""
    m = _SPLIT.match(text)
    if m and len(terms(m[1])) >= 3 and len(terms(m[2])) >= 1:
        return terms(m[1]), terms(m[2])
    t = terms(text)
    return t[: (len(t) + 1) // 2], t[(len(t) + 1) // 2 :]


def _grams(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(3, len(ids))
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n else set()


class _Numbers(dict):
    """Term numbers by word as it is written."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        t = term(word)
        k = self[word] = self.vocabulary.get(t, -1) if t else -2
        return k


class Index:
    """The postings of one block of items, with normalised BM25 impacts."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float, longest: int):
        self.longest = longest
        self.vocabulary: dict[str, int] = {}
        self.names, self.parts, self.lengths = [], [], []
        lists: list[list[tuple[int, float]]] = []
        #: items of few words, by their term numbers
        self.short: dict[tuple[int, ...], list] = {}
        for name, text in items:
            t = terms(text)
            if len(t) < LEAST:
                for x in t:
                    if self.vocabulary.setdefault(x, len(self.vocabulary)) == len(lists):
                        lists.append([])
                if t:
                    self.short.setdefault(tuple(self.vocabulary[x] for x in t), []).append(name)
                continue
            tf: dict[str, int] = {}
            for x in t:
                tf[x] = tf.get(x, 0) + 1
            weight = {x: math.log(1 + (n_items - df.get(x, 1) + 0.5) / (df.get(x, 1) + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / mean_length)) for x, c in tf.items()}
            total = sum(weight.values())
            d = len(self.names)
            self.names.append(name)
            self.lengths.append(len(t))
            for x, w in weight.items():
                k = self.vocabulary.setdefault(x, len(self.vocabulary))
                if k == len(lists):
                    lists.append([])
                lists[k].append((d, w / total))
            q, a = question_and_answer(text)
            self.parts.append((_grams([self.vocabulary[x] for x in q]), _grams([self.vocabulary[x] for x in a])))
        #: neighbouring items form a group, whose postings (items, impacts, block maxima) are kept by term
        wide = max(1, -(-len(self.names) // GROUPS))
        self.grouped = np.zeros((len(lists), -(-len(self.names) // wide)), np.float32)
        self.postings: list[dict[int, tuple[list[int], list[float], list[float]]]] = [{} for _ in range(self.grouped.shape[1])]
        for k, p in enumerate(lists):
            for g in sorted({d // wide for d, _ in p}):
                own = [(d, w) for d, w in p if d // wide == g]
                weights = [w for _, w in own]
                self.postings[g][k] = ([d for d, _ in own], weights, [max(weights[i : i + BLOCK]) for i in range(0, len(own), BLOCK)])
                self.grouped[k, g] = max(weights)
        self.short_hashes = {n: np.unique([_windows(np.array(x), n)[0] for x in self.short if len(x) == n]) for n in sorted({len(x) for x in self.short})}
        self.seen = _Numbers(self.vocabulary)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen = _Numbers(self.vocabulary)

    def ids(self, words: list[str]) -> np.ndarray:
        """Term numbers; -1 for a word outside the index, -2 for one that is punctuation only."""
        if len(self.seen) > SEEN:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def search(self, query: list[int], threshold: float, group: int) -> list[tuple[int, float]]:
        """Block-max WAND: all items of the group whose score reaches the threshold."""
        threshold -= 1e-9
        lists = self.postings[group]
        #: (current item, place in the list, items, impacts, block maxima, largest impact)
        cursor = [(p[0][0], 0, *p, max(p[2])) for p in map(lists.get, query) if p]
        found = []
        while cursor:
            cursor.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursor):
                total += c[5]
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the item give a closer bound, good up to the end of the nearest block
            close, good = 0.0, cursor[pivot + 1][0] if pivot + 1 < len(cursor) else len(self.names)
            for _, p, items, _, maxima, _ in cursor[: pivot + 1]:
                block = p // BLOCK
                while block < len(maxima) and items[min((block + 1) * BLOCK, len(items)) - 1] < item:
                    block += 1
                if block < len(maxima):
                    close += maxima[block]
                    good = min(good, items[min((block + 1) * BLOCK, len(items)) - 1] + 1)
            target = item
            if close < threshold:
                target = max(good, item + 1)
            elif cursor[0][0] == item:
                score = sum(c[3][c[1]] for c in cursor[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            moved = []
            for d, p, items, impacts, maxima, most in cursor[: pivot + 1]:
                while p < len(items) and items[p] < target:
                    p += 1
                if p < len(items):
                    moved.append((items[p], p, items, impacts, maxima, most))
            cursor = moved + cursor[pivot + 1 :]
        return found

    def whole(self, k: np.ndarray) -> list[tuple]:
        """The items of few words that stand in the text as they are."""
        found: dict[tuple[int, ...], int] = {}
        for n, hashes in self.short_hashes.items():
            if k.size >= n:
                for a in np.flatnonzero(np.isin(_windows(k, n), hashes)).tolist():
                    found.setdefault(tuple(k[a : a + n].tolist()), a)
        return [(name, a, len(x), 1.0, 1.0, 1.0) for x, a in found.items() for name in self.short.get(x, ())]

    def matches(self, text: str, threshold: float, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
        """(item, first word, words, score, question overlap, answer overlap): the best verified place of each item.

        Words are those of ``split``, from 0, with those that are punctuation only."""
        k = self.ids(split(text))
        place = np.flatnonzero(k > -2)
        k = k[place]
        inside = np.flatnonzero(k >= 0)
        if not inside.size:
            return []
        whole = [(name, int(place[a]), int(place[a + n - 1] - place[a]) + 1, *rest) for name, a, n, *rest in self.whole(k)]
        if not self.names:
            return whole
        size = 2 * self.longest
        starts = np.arange(0, max(k.size - self.longest, 1), self.longest)
        ends = np.minimum(starts + size, k.size)
        sums = np.zeros((inside.size + 1, self.grouped.shape[1]), np.float32)
        np.cumsum(self.grouped[k[inside]], axis=0, out=sums[1:])
        able = (sums[np.searchsorted(inside, ends)] - sums[np.searchsorted(inside, starts)]).max(axis=1) >= threshold - 1e-3
        best: dict[int, tuple] = {}
        for a, z in zip(starts[able].tolist(), ends[able].tolist(), strict=True):
            passage = k[a:z]
            query = np.unique(passage[passage >= 0])
            likely = np.flatnonzero(self.grouped[query].sum(axis=0) >= threshold - 1e-4).tolist()
            terms_ = query.tolist() if likely else []
            hits = [h for g in likely for h in self.search(terms_, threshold, g)]
            if hits:
                seen = _grams(passage.tolist()) if len(passage) < 3 else set(zip(*(passage[i : passage.size - 2 + i].tolist() for i in range(3)), strict=True))
                for d, score in hits:
                    q, w = self.parts[d]
                    oq = len(q & seen) / len(q) if q else 1.0
                    ow = self._overlap(w, seen, passage) if w else 1.0
                    if oq >= overlap and ow >= overlap and (d not in best or (oq + ow, score) > (best[d][4] + best[d][5], best[d][3])):
                        at, n = self._place(passage, q | w, self.lengths[d])
                        best[d] = (self.names[d], int(place[a + at]), int(place[a + at + n - 1] - place[a + at]) + 1, score, oq, ow)
        return [*best.values(), *whole]

    @staticmethod
    def _place(passage: np.ndarray, grams: set, length: int) -> tuple[int, int]:
        """(first, words): the stretch of the item's length that holds most of its word groups, from the first to the last of them."""
        p = passage.tolist()
        n = max(map(len, grams))
        hit = np.array([tuple(p[i : i + n]) in grams for i in range(len(p) - n + 1)], bool)
        if not hit.any():
            return 0, len(p)
        wide = max(1, length - n + 1)
        sums = np.concatenate(([0], np.cumsum(hit)))
        starts = np.arange(hit.size)
        best = int(np.argmax(sums[np.minimum(starts + wide, hit.size)] - sums[starts]))
        inside = np.flatnonzero(hit[best : best + wide]) + best
        return int(inside[0]), int(inside[-1] - inside[0]) + n

    @staticmethod
    def _overlap(grams: set, seen: set, passage: np.ndarray) -> float:
        n = len(next(iter(grams)))
        if n < 3:  # a short answer stands as it is
            p = passage.tolist()
            seen = set(zip(*(p[i : len(p) - n + 1 + i] for i in range(n)), strict=True))
        return len(grams & seen) / len(grams)


def indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 16 << 20):
    """The index, block by block; a block's items are at most ``block_bytes`` and one item."""
    usable = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def tokens(batches):
        for b in batches:
            if b.num_rows:
                lists = [terms(t) for t in texts_of(b)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([sorted(set(x)) for x in lists], pa.list_(pa.string()))], names=["item", "n", "terms"])

    kind = dict(usable.dtypes)["item"]
    listed = map_batches(usable, tokens, f"item {kind}, n long, terms array<string>").where("n > 0")
    every, n, mean, longest = listed.agg(F.count("*"), F.count_if(F.col("n") >= LEAST), F.avg(F.when(F.col("n") >= LEAST, F.col("n"))), F.max("n")).first()
    if not every:
        return
    listed = listed.where(F.col("n") >= LEAST)
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    df = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("item"), F.lit(blocks)) == k
        own = listed.where(mine).select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["df"] for r in df.join(own, "term").collect()}
        rows = sorted((r["item"], r["text"]) for r in usable.where(mine).collect())
        yield Index(rows, counts, n, mean, longest)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.55, overlap: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, first_word, n_words, score, question_overlap, answer_overlap) of every verified pair."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)["item_id"]
    schema = f"`{id_col}` {kind}, item_id {item_kind}, first_word long, n_words long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    out = None
    for index in indexes(items, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for b in slices(batches):
                at, rows = [], []
                for i, t in enumerate(texts_of(b)):
                    got = own.matches(t, threshold, overlap)
                    rows += got
                    at += [i] * len(got)
                if rows:
                    kinds = [pa.from_numpy_dtype(np.int64)] * 3 + [pa.float64()] * 3
                    columns = [pa.array(c, x if j else None) for j, (c, x) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *columns], names=[id_col, "item_id", "first_word", "n_words", "score", "question_overlap", "answer_overlap"])

        found = map_batches(texts, run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", threshold: float = 0.55, overlap: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no item is verified, all columns as they are; rows stay where they lie."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for index in indexes(items, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for b in slices(batches):
                if b.num_rows:
                    yield b.filter(pa.array([not own.matches(t or "", threshold, overlap) for t in b.column(place).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
