"""Perplexities, limits and decisions against a plain interpolated modified Kneser-Ney model."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import quality_lm as q

from .test_operators import prose

N = 4


class Plain:
    def __init__(self, texts):
        pad = "\n" * (N - 1)
        self.c = {N: collections.Counter(t[i : i + N] for t in (pad + q.normalise(x) for x in texts if q.normalise(x)) for i in range(len(t) - N + 1))}
        for n in range(N - 1, 0, -1):
            self.c[n] = collections.Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.kinds = {}, collections.defaultdict(int), collections.defaultdict(collections.Counter)
        for n, counts in self.c.items():
            many = collections.Counter(counts.values())
            n1, n2, n3, n4 = (many[k] for k in (1, 2, 3, 4))
            if n1 and n2 and n3 and n4:
                y = n1 / (n1 + 2 * n2)
                raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
                self.d[n] = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw)]
            else:
                self.d[n] = [0.5, 1.0, 1.5]
            for g, c in counts.items():
                self.total[n, g[:-1]] += c
                self.kinds[n, g[:-1]][min(c, 3)] += 1

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        h = g[:-1]
        below = self.p(g[1:])
        if (n, h) not in self.total:
            return below
        c, total = self.c[n][g], self.total[n, h]
        held = sum(self.d[n][k - 1] * m for k, m in self.kinds[n, h].items())
        return max(c - (self.d[n][min(c, 3) - 1] if c else 0), 0) / total + held / total * below

    def values(self, text):
        """(mean, second worst word's mean) of negative log probabilities, or None."""
        t = q.normalise(text)
        if not t:
            return None
        t = "\n" * (N - 1) + t
        logs = [-math.log(self.p(t[i - N + 1 : i + 1])) for i in range(N - 1, len(t))]
        words, at = [], 0
        for w in t[N - 1 :].split(" "):
            wide = min(len(w) + 1, len(logs) - at)
            if wide >= q.WORD_CHARS:
                words.append(sum(logs[at : at + wide]) / wide)
            at += wide
        return sum(logs) / len(logs), sorted(words)[-2] if len(words) > 1 else None


def rows():
    r = random.Random(3)
    out = [(i, prose(r.randint(3, 120), 100 + i), "en" if i % 3 else "de") for i in range(70)]
    out += [(200 + i, "".join(r.choice("zxqj ~#%") for _ in range(200)), "en") for i in range(6)]
    out += [(300, None, "en"), (301, "", None), (302, "  \t ", "de"), (303, prose(40, 7), None), (500, prose(80, 8), "en"), (500, "zqxj zqxjq xx jqzx " * 9, "en"), (501, prose(9, 9), "en"), (501, prose(9, 9), "en"), (None, prose(20, 10), "xx")]
    return out


def quantile(values, margin, share=0.99):
    bins = sorted(math.floor(v * q.BINS) for v in values)
    return (bins[math.ceil(len(bins) * share) - 1] + 1) / q.BINS + math.log(margin) if bins else None


@pytest.mark.parametrize("shard_rows", [2_000_000, 700])
def test_equals_a_plain_model(spark, shard_rows):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    half = {r.text: r.h for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).distinct().collect()}
    trusted = [(t, l) for i, t, l in table if i is not None and i < 60]
    models = {k: Plain([t for t, _ in trusted if half[t] != k]) for k in (0, 1)}
    scored = [(i, l, len(q.normalise(t or "")), models[half[t]].values(t or "")) for i, t, l in table]
    good = [(l, n, v) for i, l, n, v in scored if i is not None and i < 60]
    assert min(collections.Counter(l for l, *_ in good).values()) >= 20 - 1
    lang = {l: [x for x in good if x[0] == l] for l in ("en", "de")}

    def limits(l):
        own = lang[l] if len(lang.get(l, ())) >= q.LEAST else good
        words = [v[1] for _, _, v in own if v[1] is not None]
        words = words if own is good or len(words) >= 1 else [v[1] for _, _, v in good if v[1] is not None]
        return quantile([v[0] - 2 / math.sqrt(n) for _, n, v in own], 1.05), quantile(words, 1.05)

    want = []
    for i, l, n, v in scored:
        if v is None:
            want.append((i, l, None, False))
            continue
        mean, word = limits(l)
        fine = v[0] <= mean + 2 / math.sqrt(n) and (v[1] is None or v[1] <= word)
        want.append((i, l, v[0], fine))
    got = [(r.doc_id, r.lang, None if r.perplexity is None else math.log(r.perplexity), r.kept) for r in q.classify(docs, labels, shard_rows=shard_rows).collect()]
    key = lambda x: (str(x[0]), str(x[1]), x[2] or 0.0)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[3] == b[3] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or abs(a[2] - b[2]) < 1e-4
    both = sorted((p, k) for i, _, p, k in got if i == 500)
    assert both[0][1] and not both[1][1]
