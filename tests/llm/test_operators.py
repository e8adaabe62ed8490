"""Every operator against brute force on small tables, and on awkward ones."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, html_wrapper, language_crf, license_scan, media_chunks, near_dups, piece_codec, quality_lm, substring_dedup, token_counts
from mnemospark.llm.components import components
from mnemospark.llm.queries import tokenizer_path

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def awkward_rows():
    long = prose(6000, 1)
    base = prose(120, 2)
    rows = [
        (0, base, "en", "s", 1), (1, base, "en", "s", 1), (1, base, "en", "s", 1), (2, base.replace(VOCAB[0], "zz"), None, None, None), (3, None, "en", "s", None), (4, "", "de", "s", 0), (5, " \n\t ", "de", None, 3), (None, base, None, "s", 1),
        (None, None, None, None, None), (6, long, "en", "s", 1), (7, "one", "fr", "s", 3), (8, "één “word” 日本 😀 \x0b", "fr", "s", 1), (9, base[:300] + " " + prose(50, 3), "en", "s", 1), (10, "x" * 5000, "en", "s", 1), (11, "MIT License, Apache  License; general public license", "en", "s", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names operators use inside."""
    extra = {c: F.lit(7) for c in ("rid", "n", "words", "seed", "run", "node", "trusted", "chars", "score", "kept", "c", "id", "digest", "salt", "host", "component_id", "label")}
    return spark.createDataFrame(awkward_rows(), SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def as_map(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- tokens -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def odd_texts(n=1500):
    r = random.Random(3)
    parts = [*"ab  the▁\n\tzé日①😀<0x>xXQ19...", "tion", "ing", "   ", "\0", "é", "</s>", "<0x41>", "▁▁", " ", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_codec_is_exact(sp):
    c = piece_codec.codec(tokenizer_path())
    for t in [*odd_texts(), prose(300, 9), "日本語" * 50, "a" * 300, " " * 50]:
        ids = sp.encode(t)
        assert c.encode(t) == ids
        assert c.decode(ids) == sp.decode(ids)


def test_backtracking_agrees_with_merging(sp):
    c = piece_codec.codec(tokenizer_path())
    r = random.Random(8)
    for _ in range(500):
        s = "".join(r.choice("abcdefinorstu") for _ in range(r.randint(1, 30)))
        assert [c.piece[i] for i in c.backtrack(s)] == c.merge(s)


def test_codec_query(spark, awkward, empty, sp):
    rows = piece_codec.encode_decode(awkward, tokenizer_path()).collect()
    assert len(rows) == awkward.count()
    import struct

    texts = dict((i, t) for i, t, *_ in awkward_rows() if i is not None)
    for r in rows:
        if r.doc_id is not None:
            ids = [sp.bos_id(), *sp.encode(texts[r.doc_id] or ""), sp.eos_id()]
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_decode(empty, tokenizer_path()).count() == 0
    kept = as_map(piece_codec.encode_decode(awkward.where("doc_id = 7"), tokenizer_path(), keep=True))
    assert kept[7].decoded == "one"


def test_counts_resynchronise(sp):
    k = token_counts.ChunkedCounter(tokenizer_path(), 150, 12)
    for t in [*odd_texts(800), prose(2000, 4), "x" * 3000, "日本" * 700, "a" * 500 + " " + "b" * 500, " " * 900, "the " * 500]:
        assert k.count(t) == len(sp.encode(t))
    with pytest.raises(ValueError):
        token_counts.ChunkedCounter(tokenizer_path(), 10, 10)


def test_counts_query(spark, awkward, empty, sp):
    rows = token_counts.count_tokens(awkward, tokenizer_path(), limit=100, chunk_chars=400, overlap_chars=40).collect()
    texts = dict((i, t or "") for i, t, *_ in awkward_rows() if i is not None)
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id is not None:
            n = len(sp.encode(texts[r.doc_id]))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100)
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def brute_near(rows, size, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows():
    """Chains of copies at every distance from their original, copies of copies, short and empty texts."""
    r = random.Random(11)
    rows, n = [], 0
    for g in range(12):
        base = prose(r.choice([30, 60, 150]), 100 + g).split()
        for k in range(25):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 8)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = [r.choice(VOCAB)] if r.random() < 0.7 else []
            if r.random() < 0.2:
                base = w
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "solo"), (n + 3, "SOLO"), (n + 4, "solo two"), (n + 5, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize(("size", "leaf", "block"), [(2, 2000, 4 << 20), (5, 2000, 4 << 20), (2, 6, 4000)])
def test_near_duplicates(spark, size, leaf, block):
    rows = near_rows()
    want = brute_near(rows, size)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, leaf=leaf, block_bytes=block)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want


def test_near_duplicates_awkward(spark, awkward, empty):
    rows = near_dups.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.component_id, r.kept))
    assert got[0] == [(0, True)] and got[1] == [(0, False)] * 2
    assert got[3] == [(3, True)] and got[4] == [(4, True)] and got[5] == [(5, True)]
    assert got[None] == [(None, True)] * 2
    assert near_dups.near_duplicates(empty).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (500, 501), (501, 500)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substrings -------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = collections.defaultdict(list)
    for i, w in split:
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                cover[k : k + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out[i].append((len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


def substring_rows():
    r = random.Random(4)
    shared = [prose(r.randint(30, 90), 900 + k) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(r.randint(0, 60), 2000 + i)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared).split()
            a = r.randint(0, 12)
            parts += [" ".join(p[a : len(p) - r.randint(0, 12)]), prose(r.randint(0, 20), 3000 + i)]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a " * 80), (101, "a b " * 30), (102, None), (103, ""), (104, prose(35, 1)), (105, prose(35, 1)), (106, prose(34, 1)), (107, rows[0][1]), (107, rows[0][1])]
    return rows


@pytest.mark.parametrize("window", [35, 20])
def test_substrings(spark, window):
    rows = substring_rows()
    want = brute_substrings(rows, window)
    got = collections.defaultdict(list)
    for r in substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=window).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert got == want


def test_substrings_awkward(spark, awkward, empty):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    want = brute_substrings(rows, 35)
    got = collections.defaultdict(list)
    for r in substring_dedup.remove_duplicates(awkward).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring_dedup.remove_duplicates(empty).count() == 0


# --- pages ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p>";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div><aside class="sidebar"><p>Most read {n}</p></aside>
<main><article><header><h1>Title {n} &amp; more</h1></header><p>First   <b>bold</b> text {n}<br>goes on &eacute;.
<p>Second {t}</p><div class="ad-slot">Buy now {n}</div><form><label>Mail</label><input></form><ul><li>one {n}<li>two {n}</ul>
<p>Share this page</p><section id="comments"><h2>Comments</h2><p>Reader {n} says hi</p></section></article></main>
<footer>&copy; Site</footer>"""


def test_page_layout():
    text = html_wrapper.main_text(PAGE.format(n=1, t="tt"))
    assert text == "Title 1 & more\n\nFirst bold text 1 goes on é.\n\nSecond tt\n\none 1\n\ntwo 1\n\nShare this page"
    assert html_wrapper.main_text("") == "" and html_wrapper.main_text("  ") == ""
    assert html_wrapper.main_text("plain words only") == "plain words only"
    plain = "<body><div id=menu><a href=x>Home</a></div><div><h2>Head</h2><p>Some long text here.</p><p>More of it.</p></div><div class=footer>bye</div>"
    assert html_wrapper.main_text(plain) == "Head\n\nSome long text here.\n\nMore of it."


def test_wrapper_learns_templates(spark):
    rows = [(i, f"https://a.example/p{i}", PAGE.format(n=i, t=prose(8, i))) for i in range(12)]
    rows += [(100 + i, "http://b.example/", "<article><h1>Same</h1><p>Copy of one article.</p></article>") for i in range(9)]
    rows += [(200, None, None), (201, "no url", "<p>alone"), (None, "https://a.example/n", PAGE.format(n=99, t="z")), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("reference", F.lit("x")).repartition(3)
    got = html_wrapper.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[5].endswith("one 5\n\ntwo 5")  # "Share this page" is on every page of the host
    assert texts[103] == "Same\n\nCopy of one article."
    assert texts[200] == "" and texts[201] == "alone"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_wrapper.extract(pages.where("false")).count() == 0


def test_tree_matching_is_optimal():
    """The matched weight against the plain recursion over all pairs of children."""
    import functools

    r = random.Random(6)

    def tree(depth):
        n = html_wrapper.Node(r.choice("abc"))
        n.kids = [tree(depth - 1) for _ in range(r.randint(0, 4))] if depth else []
        return n

    def plain(a, b):
        if a.tag != b.tag:
            return 0

        @functools.lru_cache(None)
        def best(i, j):
            if not i or not j:
                return 0
            return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + plain(a.kids[i - 1], b.kids[j - 1]))

        return 1 + best(len(a.kids), len(b.kids))

    for _ in range(60):
        m = html_wrapper.Matcher()
        a, b = tree(4), tree(4)
        m.sign(a)
        m.sign(b)
        assert m.weight(a.sig, b.sig) == plain(a, b)


# --- licences ---------------------------------------------------------------------------------------------------------


def test_license_scan(spark, awkward, empty):
    got = as_map(license_scan.scan(awkward))
    assert (got[11].n_words, got[11].n_base, got[11].first_word, got[11].last_word, got[11].base_labels) == (7, 3, 0, 4, "apache,gpl,mit")
    assert got[3].n_words == 0 and got[3].first_word is None and got[3].labels == "" and got[3].score == 0.0
    assert license_scan.scan(empty).count() == 0
    full = "Redistribution and use in source and binary forms, with or without changes are permitted"
    rows = [(1, full), (2, "mit mit license license mit license"), (3, "Apache License apache-license"), (4, "permission is hereby granted")] + [(10 + k, prose(20, k)) for k in range(20)]
    got = as_map(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "bsd" in got[1].labels and got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 1, 4)
    assert got[3].n_base == 1 and got[3].first_word == 1  # the no-break space is a word character
    assert got[4].labels == "" and 0 <= got[4].score < 1
    texts = [t for t in license_scan.OWN if len(t.words) >= license_scan.LONG]
    rows = [(k, "Some words. " + " ".join(t.words) + "! " + prose(30, k)) for k, t in enumerate(texts)]
    rows += [(100 + k, " ".join(w for j, w in enumerate(t.words) if j not in t.mandatory())) for k, t in enumerate(texts)]
    got = as_map(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, t in enumerate(texts):
        assert t.label in got[k].labels.split(",") and got[k].score == 1.0
        assert t.label not in got[100 + k].labels.split(",")


# --- quality ----------------------------------------------------------------------------------------------------------


def test_model_is_a_distribution_and_shards_agree(spark):
    texts = [prose(60, k) for k in range(30)]
    trusted = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = quality_lm.gram_counts(trusted, 4).cache()
    want = collections.Counter()
    for t in texts:
        s = "\n\n\n" + t
        want.update(s[i : i + 4] for i in range(len(s) - 3))
    assert {r.g: r.c for r in counts.collect()} == want
    tables = quality_lm.model_tables(counts, 4)
    whole = next(iter(quality_lm.shards(tables, 4)))
    alphabet = sorted({c for t in texts for c in t})
    for history in ("abc", "zzz", " th", "\n\n\n", "a"):
        total = 0.0
        for c in alphabet:
            total += math.exp(whole.score([history + c])[0] - whole.score([history])[0])
        total += math.exp(whole.score([history + "ሴ"])[0] - whole.score([history])[0])
        assert abs(total - 1) < 1e-3, (history, total)
    parts = list(quality_lm.shards(tables, 4, shard_rows=700))
    assert len(parts) > 3
    probe = [*texts[:5], "Something ELSE 日本", "", "q"]
    assert abs(sum(p.score(probe) for p in parts) - whole.score(probe)).max() < 1e-2


def test_quality_classifier(spark, awkward, empty):
    good = [(i, prose(150, i), "en" if i % 2 else "de") for i in range(120)]
    bad = [(1000 + i, "".join(random.Random(i).choice("#$%&QWX@!?") for _ in range(400)), "en") for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, (2000, "", "en"), (2001, None, None), (2002, prose(150, 500), None)], "doc_id long, text string, lang string").withColumn("trusted", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000, 0, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (quality_lm.SHARD_ROWS, 700):
        got = as_map(quality_lm.classify(docs, labels, shard_rows=rows))
        assert len(got) == docs.count()
        assert not any(got[1000 + i].kept for i in range(10))
        assert sum(got[i].kept for i in range(120)) >= 119 and got[2002].kept
        assert not got[2000].kept and got[2000].perplexity is None and not got[2001].kept
    none = as_map(quality_lm.classify(docs, labels.where("false")))
    assert none[1000].kept and not none[2000].kept
    assert quality_lm.classify(awkward, labels).count() == awkward.count()
    assert quality_lm.classify(empty, labels).count() == 0


# --- contamination ----------------------------------------------------------------------------------------------------


def items_table(spark):
    items = [(i, prose(20 + i % 30, 5000 + i)) for i in range(60)] + [(60, "What is the capital of nowhere land? Answer: blue cheese tower"), (61, None), (62, "too short"), (None, prose(30, 1)), (63, "")]
    return items, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))


def test_wand_finds_what_scoring_finds(spark):
    _, items = items_table(spark)
    ix = next(iter(decontaminate.indexes(items)))
    r, n = random.Random(1), len(ix.vocabulary)
    for _ in range(300):
        q = r.sample(range(n), r.randint(1, min(150, n)))
        if r.random() < 0.6:
            d = r.randrange(len(ix.names))
            q = list({t for p in ix.postings for t, x in p.items() if d in x[0]} | set(q[:30]))
        limit = r.choice([0.05, 0.1, 0.2, 0.5, 0.9])
        scores = collections.defaultdict(float)
        for p in ix.postings:
            for t in q:
                if t in p:
                    for d, w in zip(*p[t][:2]):
                        scores[d] += w
        want = {d for d, s in scores.items() if s >= limit}
        assert {d for g in range(len(ix.postings)) for d, _ in ix.search(q, limit, g)} == want


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_contamination(spark, awkward, empty, block):
    items, table = items_table(spark)
    r = random.Random(9)
    rows, want = [], set()
    for i in range(80):
        parts = prose(r.randint(0, 400), 7000 + i).split()
        if i % 4 == 0:
            k = r.randrange(61)
            at = r.randint(0, len(parts))
            parts[at:at] = items[k][1].split()
            want.add((i, k))
        if i % 8 == 1:
            parts += items[r.randrange(60)][1].split()[:7]  # a few words are no leak
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("item_id", F.lit("x")).repartition(4)
    got = decontaminate.contaminated(docs, table, block_bytes=block).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    kept = decontaminate.without_contaminated(docs, table, block_bytes=block)
    assert {x.doc_id for x in kept.collect()} == {x for x, _ in rows} - {x for x, _ in want} | {900, 901}
    assert decontaminate.contaminated(awkward, table).count() == 0
    assert decontaminate.contaminated(empty, table).count() == 0
    assert decontaminate.contaminated(docs, table.where("false")).count() == 0


def test_question_and_answer():
    assert decontaminate.question_and_answer("Who built the old tower? Anna did.") == (["who", "built", "the", "old", "tower"], ["anna", "did"])
    assert decontaminate.question_and_answer("Who built it all Answer: Anna")[1] == ["anna"]
    assert [len(x) for x in decontaminate.question_and_answer("a b c d e f g")] == [4, 3]


# --- languages --------------------------------------------------------------------------------------------------------

LANGS = {"aa": "mo ka lu te ri sa", "bb": "zug brit thaw quel vorn skep", "cc": "éli àno çeri ôva ûne"}


def tongue(lang, n, seed):
    r = random.Random(seed)
    parts = LANGS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out(spark, awkward, empty):
    rows = [(i, tongue(lang, random.Random(i).randint(3, 60), i), lang, "s", 1) for i in range(300) for lang in [list(LANGS)[i % 3]]]
    rows += [(1000, None, "aa", "s", 1), (1001, "123 !!", "aa", "s", 1), (1002, "", None, None, None), (None, tongue("aa", 9, 1), "aa", "s", 1), (1003, tongue("bb", 30, 2), None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", F.lit(3)).repartition(3)
    got = language_crf.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(300):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(300) if by[i].held_out]
    assert sum(by[i].lang_pred == list(LANGS)[i % 3] for i in held) / len(held) >= 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert language_crf.identify(empty).count() == 0
    assert {r.lang_pred for r in language_crf.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_crf.identify(awkward).count() == awkward.count()


def test_chain_posteriors_and_switches():
    rows = [(tongue(lang, 40, 50 + i), lang) for i in range(60) for lang in LANGS]
    chain = language_crf.train(rows)
    mixed = tongue("aa", 15, 1).split() + tongue("bb", 15, 2).split()
    (post,) = chain.posteriors(chain.lookup([mixed]), each=True)
    best = [chain.labels[k] for k in post.argmax(1)]
    assert sum(b == "aa" for b in best[:15]) >= 14 and sum(b == "bb" for b in best[15:]) >= 14
    # many texts at once are scored like each alone, and like the sum over all label sequences
    texts = [tongue(list(LANGS)[k % 3], k % 7, k).split() for k in range(20)]
    all_ = chain.posteriors(chain.lookup(texts))
    for t, m in zip(texts, all_):
        assert abs(chain.posteriors(chain.lookup([t]))[0] - m).max(initial=0) < 1e-4
    import itertools

    import numpy as np

    t = texts[4][:4]
    e, letters = chain.emissions(t)
    weight, mass = 0.0, np.zeros(3)
    for y in itertools.product(range(3), repeat=len(t)):
        s = math.exp(chain.start[y[0]] + sum(float(e[i, k]) for i, k in enumerate(y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:])) - float(e.max(1).sum()))
        weight += s
        for k in y:
            mass[k] += s
    assert abs(mass / weight - chain.posteriors(chain.lookup([t]))[0]).max() < 1e-3


# --- media ------------------------------------------------------------------------------------------------------------


def test_chunks_resynchronise():
    data = media_chunks.to_wave(media_chunks.payload(prose(20000, 3)))
    a = media_chunks.chunks(data)
    assert b"".join(a) == data and all(media_chunks.LEAST <= len(c) <= media_chunks.MOST for c in a[:-1])
    moved = media_chunks.chunks(b"something in front " * 9 + data)
    assert len({*a} & {*moved}) > 0.9 * len(a)
    for n in (0, 1, 191, 192, 193, 255, 256, 257):
        assert b"".join(media_chunks.chunks(b"q" * n)) == b"q" * n
        assert len(media_chunks.payload("q" * n)) == max(192, -(-n // 192) * 192)


def test_gear_hash_is_rolling():
    import numpy as np

    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    h, marks = 0, []
    for i, b in enumerate(data):
        h = (h * 2 + int(media_chunks.GEAR[b])) & 0xFFFFFFFF
        if i >= 32 and h >> (32 - media_chunks.MEAN_BITS) == 0:
            marks.append(i + 1)
    g = media_chunks.GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        g[k:] = g[k:] + (g[:-k] << np.uint32(k))
    assert [int(x) + 1 for x in np.flatnonzero(g >> np.uint32(32 - media_chunks.MEAN_BITS) == 0) if x >= 32] == marks


def test_media_round_trip(spark, awkward, empty):
    rows = media_chunks.media_features(awkward).collect()
    assert len(rows) == awkward.count()
    texts = dict((i, t or "") for i, t, *_ in awkward_rows() if i is not None)
    for r in rows:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            p = raw + b" " * (-len(raw) % 192 if raw else 192)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            assert r.media_bytes == len(p) + 44
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media_chunks.media_features(empty).count() == 0
