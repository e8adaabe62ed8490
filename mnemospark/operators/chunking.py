"""Document chunking as DataFrame expressions: fixed windows, sentences, sections, conversations, and choosing one.

Documents are (doc_id, text); chunks are (doc_id, idx, title, text, content_hash).  Every document is worked on in its
own row and in time linear in its length, without a shuffle; what is a state machine over its lines or sentences runs
as a pandas UDF over Arrow batches (``chunk_text``), all else as expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunk_text

# fixed values
MIN_BYTES, SNAP, MIN_SIZE = 30, 80, 50
STOPS = r"[.!?\n]"


def normalise(text: Column) -> Column:
    """CRLF as LF, lines without white space at their ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"[^\S\n]+(?=\n|\z)", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def lines_of(text: Column) -> Column:
    """Lines without a last empty one."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """The windows of ``fixed`` as an array of texts.

    The text is first cut into pieces of one step, so that every window is made of its next few pieces and costs the
    same wherever it stands."""
    size = max(size, MIN_SIZE)
    overlap = min(overlap, size // 2)
    step = size - overlap
    reach = -(-(size + SNAP) // step)
    def windows(p: Column) -> Column:
        n = (F.size(p) - 1) * step + F.length(F.element_at(p, -1))

        def window(i: Column) -> Column:
            here = F.array_join(F.slice(p, i + 1, reach), "")
            end = F.least(F.lit(size), n - i * step)
            return F.struct(here.alias("here"), end.alias("end"), (i * step + end >= n).alias("over"))

        def snapped(w: Column) -> Column:
            ahead = F.regexp_instr(F.substring(w["here"], w["end"] + 1, F.lit(SNAP)), F.lit(STOPS))
            low = F.greatest(w["end"] - SNAP, F.lit(0))
            behind = F.regexp_instr(F.reverse(F.substring(w["here"], low + 1, w["end"] - low)), F.lit(STOPS))
            return F.when(w["over"], w["end"]).when(ahead > 0, w["end"] + ahead).when(behind > 0, w["end"] - behind + 1).otherwise(w["end"])

        def ended(w: Column, i: Column) -> Column:
            to = snapped(w)
            return F.struct(trim(F.substring(w["here"], F.lit(1), to)).alias("text"), (i * step + to >= n).alias("last"))

        every = F.transform(F.transform(F.sequence(F.lit(0), F.size(p) - 1), window), ended)
        # the first window that reaches the end is the last
        upto = F.transform(F.array(every), lambda w: F.slice(w, F.lit(1), F.array_position(F.transform(w, lambda x: x["last"]), F.lit(True)).cast("int")))
        return F.transform(F.filter(F.element_at(upto, 1), lambda x: F.octet_length(x["text"]) >= MIN_BYTES), lambda x: x["text"])

    # what a lambda binds is computed once
    cut_up = F.transform(F.array(normalise(text)), lambda t: F.when(t != "", F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))))
    return F.element_at(F.transform(cut_up, lambda p: F.when(p.isNotNull(), windows(p)).otherwise(F.array().cast("array<string>"))), 1)


def _titled(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.array(F.lit(""), t))


def _exploded(rows: DataFrame, *more: str) -> DataFrame:
    """(doc_id, idx, title, text, content_hash, ...) from (doc_id, chunks), chunks being pairs of title and text."""
    at = rows.select("doc_id", *more, F.posexplode("chunks").alias("idx", "c"))
    return at.select("doc_id", "idx", F.get("c", F.lit(0)).alias("title"), F.get("c", F.lit(1)).alias("text"), *more).select("doc_id", "idx", "title", "text", content_hash(F.col("text")).alias("content_hash"), *more)


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that start every ``size - overlap``; an end moves to just behind the next stop
    within 80 characters, else behind the last one within 80 before.  Trimmed windows under 30 bytes are dropped."""
    return _exploded(docs.select("doc_id", _titled(fixed_windows(F.col("text"), size, overlap)).alias("chunks")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(text: pd.Series) -> pd.Series:
    """The text cut behind . ! or ? where a capital, a quote, a parenthesis or the end follows, and at least four words
    have gathered; the rest is the last."""
    return text.map(lambda t: chunk_text.sentences(t or ""))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else chunk_text.sections(t))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else chunk_text.blocks(t))


@F.pandas_udf(T.StringType())
def _spoken(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "\n".join(chunk_text.spoken(t)))


def sentence_windows(docs: DataFrame, reach: int = 2) -> DataFrame:
    """Each sentence with its neighbours up to ``reach`` away."""
    s = docs.select("doc_id", sentences(normalise(F.col("text"))).alias("s"))

    def around(x: Column, i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(0))
        return F.array(F.lit(""), F.array_join(F.slice(F.col("s"), low + 1, F.least(i + reach + 1, F.size("s")) - low), " "))

    return _exploded(s.select("doc_id", F.transform("s", around).alias("chunks")))


def is_header(line: Column) -> Column:
    """A line of # with at least three bytes behind, or numbered: digits and dots, then a capital, at most 80 bytes and
    no full stop at the end."""
    s = trim(line)
    marked = F.octet_length(trim(F.regexp_replace(s, r"^#+", ""))) >= 3
    rest = trim(F.regexp_replace(s, r"^[0-9.]+", ""))
    numbered = (F.octet_length(rest) >= 2) & rest.rlike(r"^\p{Lu}") & (F.octet_length(rest) <= 80) & ~rest.endswith(".")
    return F.when(s.startswith("#"), marked).when(s.rlike(r"^[0-9]"), numbered).otherwise(False)


def sections(docs: DataFrame) -> DataFrame:
    """One chunk per header with its body; code fences hide headers; a body under 30 bytes goes unless it is the last;
    fewer than two headers give nothing."""
    return _exploded(docs.select("doc_id", _sections(normalise(F.col("text"))).alias("chunks")))


def _talk(text: Column) -> Column:
    """Blocks of questions, or windows of 800 with overlap 100 over what is spoken where there are fewer than two."""
    b = _blocks(normalise(text))
    few = F.when(b.isNull(), _spoken(normalise(text)))
    return F.coalesce(b, _titled(fixed_windows(few, 800, 100)))


def conversation(docs: DataFrame) -> DataFrame:
    """One chunk per question line up to the next; lines that are only a time are dropped; what stands before the first
    question is an introduction if it has 30 bytes.  Fewer than two questions: windows of 800 with overlap 100."""
    return _exploded(docs.select("doc_id", _talk(F.col("text")).alias("chunks")))


def strategy_of(text: Column) -> Column:
    """tree, conversation or fixed, from the share of header, time and question lines."""

    def count(l: Column, test) -> Column:
        return F.size(F.filter(l, test))

    def time(line: Column) -> Column:
        s = trim(line)
        return (F.octet_length(s) >= 4) & s.rlike("^[0-9]") & s.contains(":") & (F.octet_length(s) <= 8)

    def choose(l: Column) -> Column:
        n, h, t, q = F.greatest(F.size(l), F.lit(1)), count(l, is_header), count(l, time), count(l, lambda x: trim(x).endswith("?"))
        return F.when(h * 10 > n, "tree").when((t * 5 > n) | ((q > 3) & (t > 3)), "conversation").otherwise("fixed")

    return F.element_at(F.transform(F.array(lines_of(F.coalesce(text, F.lit("")))), choose), 1)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, strategy) of every row."""
    return docs.select("doc_id", strategy_of(F.col("text")).alias("strategy"))


def chunk(docs: DataFrame, strategy: str = "auto", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks with the strategy that was really used: sections and conversations of fewer than two chunks fall back to
    fixed windows (``tree->fixed``, ``conversation->fixed``); any other name chooses per document.  Every document is
    chunked where it lies: no row meets another, so ids may repeat or be null."""
    if strategy == "fixed":
        return fixed(docs, size, overlap).withColumn("strategy", F.lit("fixed"))
    if strategy == "sentence":
        return sentence_windows(docs).withColumn("strategy", F.lit("sentence"))
    wanted = F.lit(strategy) if strategy in ("tree", "conversation") else strategy_of(F.col("text"))
    asked = docs.select("doc_id", "text", wanted.alias("asked"))
    text = lambda s: F.when(F.col("asked") == s, F.col("text"))
    own = asked.select("doc_id", "text", "asked", _sections(normalise(text("tree"))).alias("tree"), _talk(text("conversation")).alias("talk"))
    own = own.select("doc_id", "text", "asked", F.when(F.col("asked") == "tree", F.col("tree")).when(F.col("asked") == "conversation", F.col("talk")).alias("own"))
    enough = F.coalesce(F.size("own") >= 2, F.lit(False))
    used = F.when(F.col("asked") == "fixed", "fixed").when(enough, F.col("asked")).otherwise(F.concat("asked", F.lit("->fixed")))
    rest = _titled(fixed_windows(F.when(~enough, F.col("text")), size, overlap))
    return _exploded(own.select("doc_id", used.alias("strategy"), F.when(enough, F.col("own")).otherwise(rest).alias("chunks")), "strategy")


def split_sentences(text: Column, most: int = 512) -> Column:
    """Every sentence on its own, cut behind each . ? or !, long ones into pieces of ``most`` characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])"), trim), lambda s: s != "")
    return F.flatten(F.transform(parts, lambda s: pieces(s, most)))


def pieces(s: Column, most: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(most))
    return F.when(F.length(s) <= most, F.array(s)).otherwise(F.transform(starts, lambda a: trim(F.substring(s, a + 1, F.lit(most)))))


def split_paragraphs(text: Column, most: int = 512) -> Column:
    """Paragraphs between empty lines, long ones by sentence."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), trim), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(split_sentences(p, most))))
