"""The factors of the relative Lempel-Ziv parse, against a plain search."""

import numpy as np
import pytest

from mnemospark.llm import substring_dedup
from mnemospark.llm.substring_dedup import Reference

from .test_operators import brute_substrings, substring_rows


def longest_elsewhere(pieces, p, i):
    best = 0
    for q, other in enumerate(pieces):
        for j in range(len(other)):
            if (q, j) != (p, i):
                k = 0
                while i + k < len(pieces[p]) and j + k < len(other) and pieces[p][i + k] == other[j + k]:
                    k += 1
                best = max(best, k)
    return best


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_factors_are_the_longest(letters):
    rng = np.random.default_rng(letters)
    pieces = [rng.integers(0, letters, rng.integers(1, 25)).astype(np.uint32) for _ in range(12)]
    ref = Reference(pieces)
    lists = [p.tolist() for p in pieces]
    want = [[longest_elsewhere(lists, p, i) for i in range(len(x))] for p, x in enumerate(lists)]
    assert [ref.longest[a : a + n].tolist() for a, n in zip(ref.begin, ref.sizes)] == want
    piece, start, size = ref.factors(np.arange(len(pieces)))
    for p, x in enumerate(lists):
        at, parse = 0, []
        while at < len(x):
            parse.append((at, max(want[p][at], 1)))
            at += parse[-1][1]
        order = np.argsort(start[piece == p])
        assert list(zip(start[piece == p][order].tolist(), size[piece == p][order].tolist())) == parse
    masks = ref.repeated(np.arange(len(pieces)), 6)
    assert masks == [sum(1 << i for i in range(len(x) - 5) if want[p][i] >= 6) for p, x in enumerate(lists)]


@pytest.mark.parametrize("pieces, block", [(0, 400_000), (3, 200), (4000, 1)])
def test_seeds_too_large_for_a_block_give_the_same(spark, monkeypatch, pieces, block):
    monkeypatch.setattr(substring_dedup, "PIECES", pieces)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    rows = substring_rows()
    got = {}
    for r in substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert got == brute_substrings(rows, 35)
