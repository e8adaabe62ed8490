"""The corpus pipeline: documents in, token ids out.

Each stage is (name, function of (spark, documents, directory of the tables)).  A stage's result is written as Parquet
and read again as the next one's documents; all but the last return the columns of ``documents``.  Rows are told apart
by a 128-bit key of id and text, so null and repeated ids neither fail nor multiply.

The near-duplicate stage takes shingles of five words at a similarity of 0.8.  Of rows with equal id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, drop_cut, row_key
from mnemospark.llm.decontaminate import without_contaminated
from mnemospark.llm.near_dups import near_duplicates
from mnemospark.llm.piece_codec import encode_decode
from mnemospark.llm.quality_lm import classify
from mnemospark.llm.queries import table, tokenizer_path
from mnemospark.llm.substring_dedup import remove_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("rid"))
    kept = classify(keyed, table(spark, sf_dir, "labels"), carry=("rid",)).where("kept").select("rid")
    return keyed.join(kept, "rid", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("rid"))
    kept = near_duplicates(docs, size=5, percent=80, row_names=True).where("kept").select("rid")
    return keyed.join(kept, "rid", "left_semi").dropDuplicates(["rid"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows of 35 words go; what is left stands joined by spaces."""
    clean = remove_duplicates(docs, keep=True, carry=("lang", "source", "n_chars"))
    return clean.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark item go."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded with begin and end ids, and decoded again."""
    return encode_decode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near-duplicate removal", near_dedup), ("substring deduplication", substring_dedup), ("benchmark decontamination", decontamination), ("tokenisation", tokens)]

#: Neither the language model nor the tokeniser can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if done:
            drop_cut(docs)
        docs, done = kept, True
    return STAGES[-1][1](spark, docs, sf_dir)
