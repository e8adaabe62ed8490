"""Benchmark items of few words, and of scripts without spaces."""

from mnemospark.llm import decontaminate

ITEMS = [(0, "Name the smallest prime?"), (1, "水の沸点は何度ですか百度です"), (2, "东京塔"), (3, "Name the smallest prime"), (4, "  "), (5, " ".join(f"word{k}" for k in range(20)))]
DOCS = [
    (0, "before Name the smallest prime? after"), (1, "the smallest prime has no name"), (2, "前文水の沸点は何度ですか百度です後文"), (3, "他看见了东京塔在那里"), (4, "东京的塔"), (5, "name, the SMALLEST prime"), (6, None),
    (7, "x " + " ".join(f"word{k}" for k in range(20)) + " name the smallest prime"),
]
WANT = {(0, 0), (0, 3), (2, 1), (3, 2), (5, 0), (5, 3), (7, 0), (7, 3), (7, 5)}


def test_short_and_unspaced_items_are_found(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (16 << 20, 60):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_bytes=block).collect()} == WANT
    few = items.where("item_id <> 5 and item_id <> 1")
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, few).collect()} == {1, 2, 4, 6}


def test_places_are_those_of_the_item(spark):
    item = " ".join(f"word{k}" for k in range(20))
    text = "- – " + " ".join(f"x{k}" for k in range(40)) + " ... " + item.replace("word9", "word9 --") + " " + " ".join(f"y{k}" for k in range(90))
    short = "*** one !! two name the smallest prime"
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in decontaminate.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {(1, 5): (43, 21), (2, 0): (4, 4), (2, 3): (4, 4)}
