"""Language identification by a linear-chain conditional random field over words.

Words carry affix features (first and last one to three letters), character bi- and trigrams and, if frequent in the
training rows, their identity (the lexicon); neighbouring labels carry learned transition weights.  All weights are
trained together by gradient steps on the conditional likelihood.  The first round labels every word as its row; the
second labels code-switched words anew with what the first has learned, so the transitions learn real switches.
Forward-backward gives every word's posterior; a text's language is the label with the largest posterior mass over
its words with letters, its score that label's share.

Training: at most ``per_lang`` rows a language (documented bound), taken by a hash of the id among the rows with a
language whose crc32(id) mod 5 is not 0.  Prediction reads whole texts, and nothing but texts.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing could
be learned; every input row gives one row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, texts_of

BUCKETS, WIDTH = 1 << 16, 24
_WORD = re.compile(r"\S+")


def has_letter(word: str) -> bool:
    """Whether the word has a letter; number characters such as a superscript two or a Roman eight are none."""
    return word.isalpha() or any(map(str.isalpha, word))


def _ids(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Feature ids of words given as padded rows of code points; 0 where a feature doesn't exist."""
    m, width = chars.shape
    c = chars.astype(np.uint64)
    columns = []

    def add(value: np.ndarray, kind: int, ok: np.ndarray) -> None:
        h = (value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        columns.append(np.where(ok, (h >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0)).astype(np.int32))

    step = np.uint64(1 << 21)
    rows = np.arange(m)
    head, tail = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for k in range(3):
        if k < width:
            head = head * step + c[:, k]
            tail = tail * step + c[rows, np.maximum(sizes - 1 - k, 0)]
            add(head, 1 + k, sizes > k)
            add(tail, 5 + k, sizes > k)
    for k in range(width - 1):
        add(c[:, k] * step + c[:, k + 1], 9, sizes > k + 1)
    for k in range(width - 2):
        add((c[:, k] * step + c[:, k + 1]) * step + c[:, k + 2], 10, sizes > k + 2)
    return np.stack(columns, axis=1)


def word_features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indexes into words, feature ids) for words of like width; every character takes part."""
    out = []
    sizes = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(sizes <= WIDTH)
    for a in range(0, short.size, 20_000):
        at = short[a : a + 20_000]
        chars = np.array([words[i] for i in at], dtype=f"U{WIDTH}").view(np.uint32).reshape(at.size, WIDTH)
        out.append((at, _ids(chars, sizes[at])))
    for i in np.flatnonzero(sizes > WIDTH):
        out.append((np.array([i]), _ids(np.array([[ord(x) for x in words[i]]], np.uint32), sizes[i : i + 1])))
    return out


class Chain:
    """Labels, feature weights, lexicon weights and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], own: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.lexicon, self.own, self.moves, self.start = labels, weights, lexicon, own, moves, start
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def __getstate__(self):
        return (self.labels, self.weights, self.lexicon, self.own, self.moves, self.start)

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score per label, has a letter) of each word."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        lowered = [w.lower() for w in words]
        for at, ids in word_features(lowered):
            for k in range(ids.shape[1]):
                out[at] += self.weights[ids[:, k]]
        for i, w in enumerate(lowered):
            j = self.lexicon.get(w)
            if j is not None:
                out[i] += self.own[j]
        letters = np.array([has_letter(w) for w in lowered], bool)
        out[~letters] = 0
        return out, letters

    def lookup(self, texts: list[list[str]], bound: int = 200_000) -> list[np.ndarray]:
        """Word indexes of each text; new words are scored together, and forgotten when there are too many."""
        if len(self.known) > bound:
            self.known, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        fresh = list(dict.fromkeys(w for t in texts for w in t if w not in self.known))
        if fresh:
            e, l = self.emissions(fresh)
            base = len(self.known)
            self.scores, self.letters = np.concatenate((self.scores, np.exp(e - e.max(axis=1, keepdims=True)))), np.concatenate((self.letters, l))
            self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]

    def posteriors(self, texts: list[np.ndarray], each: bool = False):
        """Posterior mass per label over the words with letters of each text; or with ``each`` the words' posteriors."""
        order = sorted(range(len(texts)), key=lambda i: -texts[i].size)
        sizes = np.array([texts[i].size for i in order], np.int64)
        k = len(self.labels)
        mass = np.zeros((len(texts), k))
        if not sizes.size or not sizes[0]:
            return [np.zeros((0, k))] * len(texts) if each else mass
        # all texts advance together: step t holds those longer than t, the longest first
        active = sizes.size - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        offset = np.concatenate(([0], np.cumsum(active)))
        rank = np.repeat(np.arange(sizes.size), sizes)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = offset[step] + rank
        index = np.empty(place.size, np.int64)
        index[place] = np.concatenate([texts[i] for i in order])
        e = self.scores[index]
        lettered = self.letters[index].astype(np.float32)[:, None]
        alpha = np.empty_like(e)
        moves, back = np.exp(self.moves).astype(np.float32), np.exp(self.moves).T.astype(np.float32).copy()
        a = np.exp(self.start)[None, :].astype(np.float32) * e[: offset[1]]
        alpha[: offset[1]] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, active.size):
            lo, hi = offset[t], offset[t + 1]
            a = alpha[offset[t - 1] : offset[t - 1] + hi - lo] @ moves
            a *= e[lo:hi]
            a /= a.sum(axis=1, keepdims=True)
            alpha[lo:hi] = a
        beta = np.ones((0, k), np.float32)
        total = np.zeros((sizes.size, k))
        gamma = alpha if each else None
        for t in range(active.size - 1, -1, -1):
            lo, hi = offset[t], offset[t + 1]
            if hi - lo > beta.shape[0]:
                beta = np.concatenate((beta, np.ones((hi - lo - beta.shape[0], k), np.float32)))
            g = alpha[lo:hi] * beta
            g /= g.sum(axis=1, keepdims=True)
            if each:
                gamma[lo:hi] = g
            total[: hi - lo] += g * lettered[lo:hi]
            beta = (beta * e[lo:hi]) @ back
            beta /= beta.sum(axis=1, keepdims=True)
        if each:
            flat = gamma[place]
            ends = np.cumsum(sizes)
            out: list = [None] * len(texts)
            for r, i in enumerate(order):
                out[i] = flat[ends[r] - sizes[r] : ends[r]]
            return out
        mass[order] = total
        return mass


def _forward_backward(e: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, t, k) and expected transitions (k, k) of equally long pieces with scores e (n, t, k)."""
    n, t, k = e.shape
    x, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    a = np.exp(start) * x[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * x[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        b = x[:, i + 1] * beta[:, i + 1]
        joint = alpha[:, i, :, None] * m[None] * b[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = b @ m.T
        beta[:, i] = b / b.sum(1, keepdims=True)
    g = alpha * beta
    return g / g.sum(2, keepdims=True), pairs


def train(rows: list[tuple[str, str]], *, rounds: int = 2, piece: int = 16, batch: int = 512, rate: float = 0.15, lexicon_least: int = 8) -> Chain | None:
    """Fit on (text, language) rows."""
    labels = sorted({l for _, l in rows})
    texts = [(_WORD.findall(t), labels.index(l)) for t, l in rows]
    texts = [(w, l) for w, l in texts if w]
    if not texts:
        return None
    k = len(labels)
    names = list(dict.fromkeys(w.lower() for ws, _ in texts for w in ws))
    index = {w: i for i, w in enumerate(names)}
    seq = [np.fromiter((index[w.lower()] for w in ws), np.int64, len(ws)) for ws, _ in texts]
    counts = np.bincount(np.concatenate(seq), minlength=len(names))
    lexicon = {names[i]: j for j, i in enumerate(np.flatnonzero(counts >= lexicon_least).tolist())}
    own_of = np.array([lexicon.get(w, len(lexicon)) for w in names])
    lettered = np.array([has_letter(w) for w in names])
    feats = word_features(names)
    wide = max(f.shape[1] for _, f in feats)
    ids = np.zeros((len(names), wide), np.int32)
    for at, f in feats:
        ids[at, : f.shape[1]] = f
    ids[~lettered] = 0
    w, own = np.zeros((BUCKETS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32)
    gw, go = np.full((BUCKETS, k), 1e-2, np.float32), np.full((len(lexicon) + 1, k), 1e-2, np.float32)
    moves, start = np.zeros((k, k)), np.zeros(k)
    gm = np.full((k, k), 1e-2)
    target = [np.full(s.size, l) for s, (_, l) in zip(seq, texts, strict=True)]
    rng = np.random.default_rng(9)
    for r in range(rounds):
        pieces = [(s[a : a + piece], y[a : a + piece]) for s, y in zip(seq, target, strict=True) for a in range(0, s.size, piece) if s.size - a >= piece]
        pieces += [(np.resize(s, piece), np.resize(y, piece)) for s, y in zip(seq, target, strict=True) if s.size < piece]
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            x, y = np.stack([pieces[i][0] for i in at]), np.stack([pieces[i][1] for i in at])
            used, inv = np.unique(x, return_inverse=True)
            score = w[ids[used]].sum(1) + own[own_of[used]] * lettered[used, None]
            g, pairs = _forward_backward(score[inv.reshape(x.shape)].astype(np.float64), moves, start)
            truth = np.eye(k)[y]
            diff = ((truth - g) * lettered[x][..., None]).reshape(-1, k)
            per = np.stack([np.bincount(inv.ravel(), diff[:, c], minlength=used.size) for c in range(k)], 1).astype(np.float32)
            dw = np.stack([np.bincount(ids[used].ravel(), np.repeat(per[:, c], wide), minlength=BUCKETS) for c in range(k)], 1).astype(np.float32)
            dw[0] = 0
            do = np.stack([np.bincount(own_of[used], per[:, c], minlength=own.shape[0]) for c in range(k)], 1).astype(np.float32)
            do[-1] = 0
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            dm = seen - pairs
            for value, grad, square in ((w, dw, gw), (own, do, go), (moves, dm, gm)):
                square += grad * grad
                value += rate * grad / np.sqrt(square)
        if r + 1 < rounds:  # words that the row's label doesn't fit get the label they are most likely in
            chain = Chain(labels, w, lexicon, own, moves, start)
            words = [ws for ws, _ in texts]
            for i in range(0, len(words), 500):
                post = chain.posteriors(chain.lookup(words[i : i + 500]), each=True)
                for j, p in enumerate(post):
                    best = p.argmax(1)
                    target[i + j] = np.where(p.max(1) > 0.9, best, target[i + j])
    return Chain(labels, w, lexicon, own[: len(lexicon)] if lexicon else own, moves, start)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> list[tuple[str, str]]:
    """About ``per_lang`` rows of each language by a hash of the id, never more than twice that."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(True)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    part = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(9)), F.lit(1 << 20))
    take = F.lit(False)
    for lang, n in counts.items():
        take = take | ((F.col(lang_col) == lang) & (part < int((1 << 20) * min(1.0, per_lang / n))))
    rows = usable.where(take).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).limit(2 * per_lang * len(counts)).collect()
    return sorted((r["t"], r["l"]) for r in rows)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, words_at_once: int = 1_000_000) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    kind = dict(docs.dtypes)[id_col]
    model = train(training_rows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        chain = shared.value
        for b in slices(batches, 8 << 20):
            texts = [_WORD.findall(t) for t in texts_of(b)]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            a = 0
            while chain is not None and a < len(texts):
                z, n = a, 0
                while z < len(texts) and (z == a or n + len(texts[z]) <= words_at_once):
                    n += len(texts[z])
                    z += 1
                mass = chain.posteriors(chain.lookup(texts[a:z]))
                total = mass.sum(1)
                for i in np.flatnonzero(total > 0).tolist():
                    best = int(mass[i].argmax())
                    langs[a + i], scores[a + i] = chain.labels[best], min(1.0, float(mass[i, best] / total[i]))
                a = z
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(f"`{id_col}`"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(picked, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
