"""What marks an element of a page, and what counts as a letter."""

import pytest

from mnemospark.llm import html_wrapper, language_crf


@pytest.mark.parametrize(
    "attrs, kept",
    [
        ('style="overflow:hidden"', True), ('data-id="menu-3"', True), ('title="hidden gem"', True), ('id="comment-on-the-budget"', True), ("data-x='class=menu'", True), ('data-hidden="1"', True),
        ('class="menu"', False), ("class=sidebar", False), ('id="comment-12"', False), ("hidden", False), ('aria-hidden="true"', False), ('class="wide newsletter-box"', False), ("ROLE='navigation'", False), ('class="&#109;enu"', False),
    ],
)
def test_attributes(attrs, kept):
    page = f"<html><body><article><p>First words of it.</p><div {attrs}>Second words of it.</div><p>Third.</p></article></body></html>"
    assert html_wrapper.main_text(page) == "First words of it.\n\n" + ("Second words of it.\n\n" if kept else "") + "Third."


def test_number_characters_are_no_letters(spark):
    rows = [(i, f"mo ka lu te ri {i}" if i % 2 else f"zug brit thaw quel {i}", "aa" if i % 2 else "bb") for i in range(60)] + [(100 + k, t, None) for k, t in enumerate(["²", "½ Ⅷ", "① 7", "mo ²", "Ⅷ_"])]
    got = {r.doc_id: r.lang_pred for r in language_crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.doc_id >= 100}
    assert [got[100 + k] for k in range(5)] == ["und", "und", "und", "aa", "und"]
