"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_duplicates

    return remove_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_crf import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_chunks import media_features

    return media_features(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Sets of two-word shingles, candidates that share one of the rarest fifth, links on full sets, and their closure.
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r), f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
x AS (SELECT r, g, n, row_number() OVER (PARTITION BY r ORDER BY df, g) AS k FROM s JOIN f USING (g) JOIN n USING (r)),
p AS (SELECT r, g, n FROM x WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b, a.n AS na, b.n AS nb FROM p a JOIN p b USING (g) WHERE a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, na, nb, count(*) AS m FROM c JOIN s y ON y.r = c.a JOIN s z ON z.r = c.b AND z.g = y.g GROUP BY a, b, na, nb),
l AS (SELECT a, b FROM i WHERE 100 * m >= 80 * (na + nb - m)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
t AS (SELECT r AS u, r AS v FROM d UNION SELECT t.u, e.v FROM t JOIN e ON e.u = t.v),
o AS (SELECT t.u AS r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.v GROUP BY t.u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN o USING (r) LEFT JOIN n USING (r)"""

#: All windows of 35 words, those that start in two places, and the words that they cover.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1), m AS (SELECT r, i FROM h JOIN g USING (k)),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT p.r, p.i, x, max(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN m ON m.r = p.r AND m.i = p.i),
a AS (SELECT r, count(*) FILTER (gone = 1) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM q GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_extraction": op1_html_extraction, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_sentencepiece": op3_sentencepiece, "op4_substring_dedup": op4_substring_dedup, "op5_quality_classifier": op5_quality_classifier, "op6_license_scan": op6_license_scan, "op7_decontamination": op7_decontamination, "op8_token_counts": op8_token_counts, "op9_language_id": op9_language_id, "op10_media_chunks": op10_media_chunks}


def oracle_sql() -> dict[str, str]:
    from .license_scan import scan_sql

    return {"op2_minhash_near_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_license_scan": scan_sql()}
