"""Registered text queries: BM25, hybrid rerank, chunking, readers, validation, ingest differences, section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, chunking, ingest, log, search, tree
from ..sources import files
from .vectors import _R, _l2, query, records

QUESTION = "the of and onin erth"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("id"), "text")


def bm25_stats(spark, d):
    return bm25.corpus_stats(corpus(spark, d)).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def bm25_document_frequency(spark, d):
    return bm25.document_frequencies(corpus(spark, d))


def bm25_rank(spark, d):
    found = bm25.scores(corpus(spark, d), bm25.query_terms(spark, QUESTION))
    return found.select("id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(20)


def hybrid_rerank(spark, d):
    """Vector hits of one record, blended with BM25 of the documents of the same ids; the whole pool is reranked."""
    from pyspark.sql import Window as W

    r = records(spark, d)
    pool = search.nearest(r, query(r), search.overfetch(5, rerank=True)).withColumn("rank", F.row_number().over(W.orderBy("dist", "id")))
    out = bm25.hybrid(pool.select("id", F.col("dist").cast("double").alias("distance"), "rank"), corpus(spark, d), QUESTION, 5)
    return out.select("id", F.round("bm25", 6).alias("bm25"), F.round("blended", 6).alias("blended"))


def tokens_bm25(spark, d):
    return corpus(spark, d).select("id", F.size(bm25.tokens(F.col("text"))).alias("n_tokens"))


def tokens_tree(spark, d):
    return corpus(spark, d).select("id", F.size(tree.terms(F.col("text"))).alias("n_tokens"))


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content_hash"))), lambda s: s["content_hash"]), ""), 256).alias("digest"))


def chunk_fixed(spark, d):
    return _digest(chunking.fixed(documents(spark, d)))


def chunk_sentence(spark, d):
    return _digest(chunking.sentence_windows(documents(spark, d)))


def chunk_tree(spark, d):
    return _digest(chunking.chunk(_markdown(spark, d), "tree"))


def chunk_conversation(spark, d):
    return _digest(chunking.chunk(_talks(spark, d), "conversation"))


def chunk_auto(spark, d):
    return chunking.chunk(documents(spark, d)).groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks"))


def detect_strategy(spark, d):
    return chunking.detect(documents(spark, d).unionByName(_markdown(spark, d).withColumn("lang", F.lit("en"))))


def split_paragraphs(spark, d):
    return documents(spark, d).select("doc_id", chunking.split_paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.aggregate("p", F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


def split_sentences(spark, d):
    return documents(spark, d).select("doc_id", chunking.split_sentences(F.col("text"), 512).alias("p")).select("doc_id", F.size("p").alias("n"), F.aggregate("p", F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


def _talks(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet")
    line = F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))


def _markdown(spark, d) -> DataFrame:
    """Markdown made of the benchmark's items: each eight are a document with nested headers."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    level = F.element_at(F.array(F.lit("#"), F.lit("##"), F.lit("###"), F.lit("##")), (F.col("item_id") % 4 + 1).cast("int"))
    part = F.concat(level, F.lit(" Section "), F.col("item_id").cast("string"), F.lit(" "), F.substring_index("text", " ", 3), F.lit("\n"), F.col("text"), F.lit("\n"))
    return b.groupBy((100_000 + F.floor(F.col("item_id") / 8)).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", part.alias("p")))), lambda s: s["p"]), "\n").alias("text"))


def tree_build(spark, d):
    return tree.build(_markdown(spark, d)).select("doc_id", "node_id", "title", "level", "start_line", "end_line", "summary", "parent")


def tree_rank(spark, d):
    return tree.rank(tree.build(_markdown(spark, d)), "section of the onin thand heat de la que")


def tree_rank_normalised(spark, d):
    return tree.rank_normalised(tree_rank(spark, d)).select("doc_id", "node_id", F.round("score", 6).alias("score"))


def tree_answer(spark, d):
    return tree.answer(tree.build(_markdown(spark, d)), "section of the onin thand heat de la que").select("doc_id", "rank", "node_id", "score", "breadcrumb", "start_line", "end_line", F.sha2("evidence", 256).alias("evidence_hash"))


def tree_hybrid(spark, d):
    r = records(spark, d)
    sections = tree_rank(spark, d).select(F.concat_ws("/", F.col("doc_id").cast("string"), "node_id").alias("id"), "score")
    hits = search.nearest(r, query(r), 20).select(F.col("id"), F.col("score").alias("distance"))
    return tree.blend(sections, hits, 8).select("source", "id", F.round("score", 6).alias("score"))


def html_text(spark, d):
    p = files.html_text(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"))
    return p.select("page_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("digest"), "author")


def html_title(spark, d):
    return files.html_text(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select("page_id", "title")


def markdown_text(spark, d):
    return files.markdown_text(_markdown(spark, d)).select("doc_id", "title", F.length("body").alias("chars"))


def format_dispatch(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    name = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, (".html", ".MD", ".docx", ".pdf", ".txt", ""))), (F.col("page_id") % 6 + 1).cast("int")))
    return p.select("page_id", files.format_of(name, mime=F.lit("text/html")).alias("format"))


def document_validation(spark, d):
    mime = F.when(F.col("doc_id") % 50 == 3, "application/pdf+protected").otherwise("text/plain")
    text = F.when(F.col("doc_id") % 40 == 1, F.lit("  ")).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", ingest.validation_error(text, mime, F.col("doc_id") % 30, max_bytes=20_000, max_pages=28).alias("error"))


def ingest_pipeline(spark, d):
    out = ingest.pipeline(documents(spark, d).where("doc_id is not null"), dim=16)
    return out.groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks"), F.max(F.size("vec")).alias("dim"))


def embed_hash(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return ingest.embed(b, "hash", 40).select("item_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def diff_ingest(spark, d):
    """The difference between the chunks of the documents and those of an edited version."""
    old = chunking.fixed(documents(spark, d))
    edited = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nOne more line that is new."))).otherwise(F.col("text")).alias("text"))
    return ingest.difference(old, chunking.fixed(edited)).groupBy("doc_id", "action").agg(F.sum("n").alias("n"))


def _numbered(spark, d) -> DataFrame:
    """The documents' windows with a record number each, in order of document and window."""
    c = chunking.fixed(documents(spark, d).where("doc_id is not null"))
    return log.number(c.withColumn("at", F.col("doc_id") * ingest.CHUNKS + F.col("idx")), "at", "record_id", 1000 * ingest.CHUNKS)


def ingest_events(spark, d):
    """The log events that write the documents' windows with zero vectors."""
    c = chunking.fixed(documents(spark, d).where("doc_id is not null"))
    own = c.select("doc_id", "idx", F.array().cast("array<int>").alias("fx"), F.col("content_hash").alias("metadata"), (F.col("doc_id") % 4).cast("int").alias("namespace_id"))
    return ingest.events(own, 100, 200, 300, 400).select("log_index", "event_type", "namespace_id", "record_id", "node_id", "edge_id", "kind", "src", "dst", "key", "value")


def diff_events(spark, d):
    """The soft deletes of an edited version."""
    edited = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A first line that is new.\n"), "text")).otherwise(F.col("text")).alias("text"))
    return ingest.removal_events(ingest.changes(_numbered(spark, d), chunking.fixed(edited.where("doc_id is not null"))), 5000)


def diff_lines(spark, d):
    """The same difference over the lines of two halves of the documents, as multisets."""
    lines = lambda t: t.select((F.col("doc_id") % 10).alias("doc_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l")).select("doc_id", F.sha2("l", 256).alias("content_hash"))
    t = documents(spark, d)
    return ingest.difference(lines(t.where("doc_id % 20 < 10")), lines(t.where("doc_id % 20 >= 10"))).groupBy("doc_id", "action").agg(F.sum("n").alias("n"))


def batch_insert(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("r"), (F.col("event_id") % 700).cast("string"))).alias("request_id"))
    seen = spark.range(100).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"))
    return ingest.batch_insert(rows, seen, 1000).select("pos", "id")


def encrypted_round_trip(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("metadata"))
    return ingest.decrypt(ingest.encrypt(b, "0123456789abcdef"), "0123456789abcdef")


QUERIES = {f.__name__: f for f in (
    bm25_stats, bm25_document_frequency, bm25_rank, hybrid_rerank, tokens_bm25, tokens_tree, chunk_fixed, chunk_sentence, chunk_tree, chunk_conversation, chunk_auto, detect_strategy, split_paragraphs, split_sentences, tree_build, tree_rank,
    tree_rank_normalised, tree_answer, tree_hybrid, html_text, html_title, markdown_text, format_dispatch, document_validation, ingest_pipeline, ingest_events, diff_events, embed_hash, diff_ingest, diff_lines, batch_insert, encrypted_round_trip,
)}

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 2)"
_POST = f"tok AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), pos AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL)"
_SCORE = f"""{_POST}, q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{QUESTION}', ' ')) AS term) GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), dl AS (SELECT id, len(t) AS dl FROM tok),
df AS (SELECT term, count(*) AS df FROM pos WHERE term IN (SELECT term FROM q) GROUP BY term),
sc AS (SELECT id, sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM pos JOIN q USING (term) JOIN df USING (term) JOIN dl USING (id), s GROUP BY id)"""
_STOPS = ", ".join(f"'{w}'" for w in tree.STOPWORDS)
_TERMS = "list_filter(regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([" + _STOPS + "], t))"
_MD = "md AS (SELECT CAST(100000 + item_id // 8 AS BIGINT) AS doc_id, string_agg(['#', '##', '###', '##'][CAST(item_id % 4 + 1 AS INT)] || ' Section ' || item_id || ' ' || array_to_string(string_split(text, ' ')[1:3], ' ') || chr(10) || text || chr(10), chr(10) ORDER BY item_id) AS text FROM benchmark GROUP BY 1)"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_NODES = f"""{_MD}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
hd AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '^#{{1,6}} +\\S') THEN length(regexp_extract(line, '^#+')) END AS level FROM ln),
nn AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS n, max(i) OVER (PARTITION BY doc_id) AS total FROM hd),
nd AS (SELECT doc_id, n, any_value(total) AS total, max(level) AS level, min(i) AS start_line, max(CASE WHEN level IS NOT NULL THEN trim(regexp_replace(line, '^#+ +', '')) END) AS title,
  {_TRIM.format("coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY i), '')")} AS own_text FROM nn WHERE n > 0 GROUP BY doc_id, n),
tr AS (SELECT a.doc_id, lpad(CAST(a.n AS VARCHAR), 4, '0') AS node_id, a.title, CAST(a.level AS INT) AS level, CAST(a.start_line AS INT) AS start_line, CAST(coalesce(lead(a.start_line) OVER (PARTITION BY a.doc_id ORDER BY a.n) - 1, a.total) AS INT) AS end_line, a.own_text,
  CASE WHEN a.own_text = '' THEN a.title ELSE trim(substr(regexp_extract(replace(a.own_text, chr(10), ' '), '^[^.!?]*[.!?]?'), 1, 160)) END AS summary,
  (SELECT lpad(CAST(max(b.n) AS VARCHAR), 4, '0') FROM nd b WHERE b.doc_id = a.doc_id AND b.n < a.n AND b.level < a.level) AS parent FROM nd a)"""
_RANK = f"""{_NODES}, qt AS (SELECT DISTINCT unnest({_TERMS.format("'section of the onin thand heat de la que'")}) AS q),
pt AS (SELECT doc_id, node_id, level, (CASE WHEN list_contains({_TERMS.format('title')}, q) THEN 5.0 ELSE 0.0 END) + (CASE WHEN list_contains({_TERMS.format('summary')}, q) THEN 2.0 ELSE 0.0 END) + least(len(list_filter({_TERMS.format('own_text')}, lambda x: x = q)), 3) AS p FROM tr, qt),
rk AS (SELECT doc_id, node_id, CAST(round(sum(p) + 0.1 * any_value(level), 2) AS DOUBLE) AS score FROM pt GROUP BY doc_id, node_id HAVING sum(p) > 0)"""
_WHITE = "[^\\S\\n]+(\\n|$)"


def _win(tag: str, frm: str, size: int = 1000, overlap: int = 200, text: str = "text") -> str:
    """Tables that end in ck{tag} (doc_id, s, text): the windows over a table's texts."""
    stop = "[.!?\\n]"
    ahead, low = "substr(t, e + 1, 80)", "greatest(e - 80, 0)"
    before = f"substr(t, {low} + 1, e - {low})"
    snap = f"CASE WHEN e >= n THEN n WHEN regexp_matches({ahead}, '{stop}') THEN e + length(regexp_extract({ahead}, '^[^.!?\\n]*[.!?\\n]')) WHEN regexp_matches({before}, '{stop}') THEN e - length(regexp_extract({before}, '[^.!?\\n]*$')) ELSE e END"
    return f"""nt{tag} AS (SELECT doc_id, regexp_replace(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), '{_WHITE}', '\\1', 'g') AS t FROM {frm}),
st{tag} AS (SELECT doc_id, t, length(t) AS n, unnest(range(0, length(t), {size - overlap})) AS s FROM nt{tag} WHERE length(t) > 0),
en{tag} AS (SELECT *, least(s + {size}, n) AS e FROM st{tag}),
sn{tag} AS (SELECT *, {snap} AS z FROM en{tag}),
lm{tag} AS (SELECT *, coalesce(max(CASE WHEN z >= n THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM sn{tag}),
ck{tag} AS (SELECT * FROM (SELECT doc_id, s, regexp_replace(substr(t, s + 1, z - s), '^\\s+|\\s+$', '', 'g') AS text FROM lm{tag} WHERE done = 0) WHERE strlen(text) >= 30)"""


def _nl(tag: str, frm: str, normal: bool = True) -> str:
    """Table ln{tag} (doc_id, i, line, s): the lines of a table's texts, without a last empty one, as they are and trimmed."""
    text = f"regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '{_WHITE}', '\\1', 'g')" if normal else "coalesce(text, '')"
    return f"""lx{tag} AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM (SELECT doc_id, {text} AS t FROM {frm})),
ly{tag} AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM lx{tag}),
ln{tag} AS (SELECT doc_id, i, line, {_TRIM.format("line")} AS s FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM ly{tag}))"""


_REST = _TRIM.format("regexp_replace(s, '^[0-9.]+', '')")
_HEAD = f"CASE WHEN s LIKE '#%' THEN strlen({_TRIM.format("regexp_replace(s, '^#+', '')")}) >= 3 WHEN regexp_matches(s, '^[0-9]') THEN strlen({_REST}) BETWEEN 2 AND 80 AND regexp_matches({_REST}, '^\\p{{Lu}}') AND NOT ends_with({_REST}, '.') ELSE false END"


def _sections(tag: str, frm: str) -> str:
    """Table own{tag} (doc_id, s, text): the sections under headers."""
    return f"""{_nl(tag, frm)},
fe{tag} AS (SELECT *, CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END AS fence, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM ln{tag}),
hx{tag} AS (SELECT *, CASE WHEN NOT inside AND fence = 0 AND {_HEAD} THEN 1 ELSE 0 END AS head FROM fe{tag}),
sx{tag} AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM hx{tag}),
bx{tag} AS (SELECT doc_id, sec, max(CASE WHEN head = 1 THEN s END) AS title, {_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (head = 0), '')")} AS body FROM sx{tag} WHERE sec > 0 GROUP BY doc_id, sec),
mx{tag} AS (SELECT *, max(sec) OVER (PARTITION BY doc_id) AS last FROM bx{tag}),
own{tag} AS (SELECT doc_id, sec AS s, title || chr(10) || body AS text FROM mx{tag} WHERE last >= 2 AND (strlen(body) >= 30 OR sec = last))"""


def _talk_blocks(tag: str, frm: str) -> str:
    """Table own{tag} (doc_id, s, text): the blocks under questions, or windows over what is spoken."""
    return f"""{_nl(tag, frm)},
sp{tag} AS (SELECT doc_id, i, s FROM ln{tag} WHERE s <> '' AND NOT (strlen(s) <= 8 AND regexp_full_match(s, '[0-9:]*'))),
qx{tag} AS (SELECT *, sum(CASE WHEN ends_with(s, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block, sum(CASE WHEN ends_with(s, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS qs FROM sp{tag}),
bk{tag} AS (SELECT doc_id, block, string_agg(s, ' ' ORDER BY i) AS text FROM qx{tag} WHERE qs >= 2 GROUP BY doc_id, block),
few{tag} AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS text FROM qx{tag} WHERE qs < 2 GROUP BY doc_id),
{_win(tag + "f", f"few{tag}", 800, 100)},
own{tag} AS (SELECT doc_id, block AS s, text FROM bk{tag} WHERE strlen(text) >= CASE WHEN block = 0 THEN 30 ELSE 20 END UNION ALL SELECT doc_id, s, text FROM ck{tag}f)"""


def _or_fixed(tag: str, frm: str) -> str:
    """Table out{tag} (doc_id, s, text, fell): a document's own chunks where there are two or more, else its windows."""
    return f"""en_{tag} AS (SELECT doc_id FROM own{tag} GROUP BY doc_id HAVING count(*) >= 2),
{_win(tag + "r", f"(SELECT doc_id, text FROM {frm} WHERE doc_id NOT IN (SELECT doc_id FROM en_{tag}))")},
out{tag} AS (SELECT own{tag}.*, false AS fell FROM own{tag} SEMI JOIN en_{tag} USING (doc_id) UNION ALL SELECT doc_id, s, text, true FROM ck{tag}r)"""


def _detected(tag: str, frm: str) -> str:
    """Table det{tag} (doc_id, strategy)."""
    return f"""{_nl(tag, frm, normal=False)},
ct{tag} AS (SELECT doc_id, greatest(count(*), 1) AS n, count(*) FILTER ({_HEAD}) AS h, count(*) FILTER (strlen(s) BETWEEN 4 AND 8 AND regexp_matches(s, '^[0-9]') AND contains(s, ':')) AS t, count(*) FILTER (ends_with(s, '?')) AS q FROM ln{tag} GROUP BY doc_id),
det{tag} AS (SELECT d.doc_id, CASE WHEN h * 10 > n THEN 'tree' WHEN t * 5 > n OR (q > 3 AND t > 3) THEN 'conversation' ELSE 'fixed' END AS strategy FROM (SELECT doc_id FROM {frm}) d LEFT JOIN ct{tag} USING (doc_id))"""


def _auto(frm: str) -> str:
    """Table auto (doc_id, strategy): one row per chunk."""
    pick = lambda s: f"(SELECT doc_id, text FROM {frm} JOIN detz USING (doc_id) WHERE strategy = '{s}')"
    return f"""{_detected("z", frm)}, {_sections("a", pick("tree"))}, {_or_fixed("a", pick("tree"))}, {_talk_blocks("b", pick("conversation"))}, {_or_fixed("b", pick("conversation"))}, {_win("c", pick("fixed"))},
auto AS (SELECT doc_id, 'tree' || CASE WHEN fell THEN '->fixed' ELSE '' END AS strategy FROM outa UNION ALL SELECT doc_id, 'conversation' || CASE WHEN fell THEN '->fixed' ELSE '' END FROM outb UNION ALL SELECT doc_id, 'fixed' FROM ckc)"""


def _told(table: str) -> str:
    return f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(sha256(text), '' ORDER BY s)) AS digest FROM {table} GROUP BY doc_id"


_TALKS = "tk AS (SELECT conv_id AS doc_id, string_agg(text || CASE WHEN turn % 2 = 0 THEN '?' ELSE '' END, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"
_DONE = f"(len(regexp_extract_all({_TRIM.format('{0}')}, '\\S+')) >= 4 AND regexp_matches({{0}}, '[.!?]$'))"
#: Cuts are marked, pieces gathered one after another until they are a sentence.
_SENTENCES = f"""{_nl("s", "documents").split(",\nly")[0]}, tx AS (SELECT doc_id, array_to_string(l, chr(10)) AS t FROM lxs),
pc AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?])([ \\n]*[\\p{{Lu}}"''(])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])([ \\n]*)$', '\\1' || chr(1) || '\\2'), chr(1)) AS p FROM tx),
pt AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM pc),
sr AS (SELECT doc_id, i, n, piece AS now, {_DONE.format("piece")} AS done FROM pt WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, x.n, x.now, {_DONE.format("x.now")} FROM (SELECT pt.doc_id, pt.i, pt.n, CASE WHEN sr.done THEN '' ELSE sr.now END || pt.piece AS now FROM sr JOIN pt ON pt.doc_id = sr.doc_id AND pt.i = sr.i + 1) x),
se AS (SELECT doc_id, i AS s, {_TRIM.format("now")} AS own FROM sr WHERE (done OR i = n) AND {_TRIM.format("now")} <> ''),
sw AS (SELECT doc_id, s, string_agg(own, ' ') OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS text FROM se)"""
_PIECES = "CASE WHEN length(s) <= 512 THEN 1 ELSE CAST(ceil(length(s) / 512.0) AS BIGINT) END"
_CHARS = f"CASE WHEN length(s) <= 512 THEN length(s) ELSE list_sum(list_transform(range(0, length(s), 512), lambda a: length({_TRIM.format('substr(s, a + 1, 512)')}))) END"
_STOPPED = "regexp_extract_all({0}, '[^.?!]*[.?!]|[^.?!]+')"

SQL = {
    "bm25_stats": f"WITH {_POST} SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total, round(avg(len(t)), 6) AS avgdl FROM tok",
    "bm25_document_frequency": f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM pos GROUP BY term",
    "bm25_rank": f"WITH {_SCORE} SELECT id, round(bm25, 6) AS bm25 FROM sc ORDER BY 2 DESC, id LIMIT 20",
    "hybrid_rerank": f"WITH {_R}, {_SCORE}, h AS (SELECT r.id, CAST({_l2('r.fx', 'q.fx')} AS DOUBLE) AS distance FROM r, (SELECT fx FROM r WHERE id = 0) q ORDER BY distance, id LIMIT 100), k AS (SELECT h.id, distance, coalesce(bm25, 0.0) AS bm25, row_number() OVER (ORDER BY distance, h.id) AS rank FROM h LEFT JOIN sc ON sc.id = h.id), m AS (SELECT min(distance) AS a, max(distance) AS b, min(bm25) AS c, max(bm25) AS e FROM k) SELECT id, round(bm25, 6) AS bm25, round(0.5 * (1 - (distance - a) / (b - a)) + 0.5 * (bm25 - c) / (e - c), 6) AS blended FROM k, m ORDER BY 0.5 * (1 - (distance - a) / (b - a)) + 0.5 * (bm25 - c) / (e - c) DESC, rank LIMIT 5",
    "tokens_bm25": f"SELECT doc_id AS id, CAST(len({_TOK}) AS INT) AS n_tokens FROM documents",
    "tokens_tree": f"SELECT doc_id AS id, CAST(len({_TERMS.format('text')}) AS INT) AS n_tokens FROM documents",
    "chunk_fixed": f"WITH {_win('', 'documents')} {_told('ck')}",
    "chunk_sentence": f"WITH RECURSIVE {_SENTENCES} {_told('sw')}",
    "chunk_tree": f"WITH {_MD}, {_sections('t', 'md')}, {_or_fixed('t', 'md')} {_told('outt')}",
    "chunk_conversation": f"WITH {_TALKS}, {_talk_blocks('t', 'tk')}, {_or_fixed('t', 'tk')} {_told('outt')}",
    "chunk_auto": f"WITH {_auto('documents')} SELECT doc_id, strategy, count(*) AS chunks FROM auto GROUP BY ALL",
    "ingest_pipeline": f"WITH fine AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND {_TRIM.format("coalesce(text, '')")} <> '' AND strlen(text) <= {50 << 20}), {_auto('fine')} SELECT doc_id, strategy, count(*) AS chunks, CAST(16 AS INT) AS dim FROM auto GROUP BY doc_id, strategy",
    "detect_strategy": f"WITH {_MD}, dm AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM md), {_detected('', 'dm')} SELECT * FROM det",
    "split_sentences": f"WITH p AS (SELECT doc_id, list_filter(list_transform({_STOPPED.format("coalesce(text, '')")}, lambda s: {_TRIM.format('s')}), lambda s: s <> '') AS p FROM documents) SELECT doc_id, CAST(coalesce(list_sum(list_transform(p, lambda s: {_PIECES})), 0) AS INT) AS n, CAST(coalesce(list_sum(list_transform(p, lambda s: {_CHARS})), 0) AS INT) AS chars FROM p",
    "split_paragraphs": f"""WITH g AS (SELECT doc_id, {_TRIM.format('g')} AS g FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS g FROM documents)),
w AS (SELECT doc_id, g AS s FROM g WHERE g <> '' AND length(g) <= 512 UNION ALL SELECT doc_id, {_TRIM.format('s')} FROM (SELECT doc_id, unnest({_STOPPED.format('g')}) AS s FROM g WHERE length(g) > 512)),
c AS (SELECT doc_id, sum({_PIECES}) AS n, sum({_CHARS}) AS chars FROM w WHERE s <> '' GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, CAST(coalesce(chars, 0) AS INT) AS chars FROM documents LEFT JOIN c USING (doc_id)""",
    "embed_hash": """WITH h AS (SELECT item_id, sha256(unhex(sha256(coalesce(text, ''))) || unhex('00000000')) || sha256(unhex(sha256(coalesce(text, ''))) || unhex('01000000')) AS x FROM benchmark),
b AS (SELECT item_id, list_transform(range(40), lambda k: CAST((16 * (instr('0123456789abcdef', x[2 * k + 1]) - 1) + instr('0123456789abcdef', x[2 * k + 2]) - 1) / 127.5 - 1.0 AS FLOAT)) AS v FROM h)
SELECT item_id, round(list_sum(list_transform(v, lambda e: CAST(e AS DOUBLE))), 4) AS total FROM b""",
    "ingest_events": f"""WITH {_win('', '(SELECT * FROM documents WHERE doc_id IS NOT NULL)')}, r AS (SELECT *, dense_rank() OVER (ORDER BY doc_id) - 1 AS g, row_number() OVER (ORDER BY doc_id, s) - 1 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM ck),
f AS (SELECT doc_id, 200 + g + n AS parent FROM r WHERE k = 1),
e AS (SELECT 400 + g + n * 4 AS log_index, 'CreateNode' AS event_type, doc_id, NULL AS record_id, 200 + g + n AS node_id, NULL AS edge_id, 5 AS kind, NULL AS src, NULL AS dst, NULL AS key, NULL AS value FROM r WHERE k = 1
UNION ALL SELECT 401 + g + n * 4, 'InsertRecord', doc_id, 100 + n, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r
UNION ALL SELECT 402 + g + n * 4, 'CreateNode', doc_id, 100 + n, 201 + g + n, NULL, 6, NULL, NULL, NULL, NULL FROM r
UNION ALL SELECT 403 + g + n * 4, 'CreateEdge', doc_id, NULL, NULL, 300 + n, 6, parent, 201 + g + n, NULL, NULL FROM r JOIN f USING (doc_id)
UNION ALL SELECT 404 + g + n * 4, 'SetMeta', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'record:' || (100 + n), sha256(text) FROM r)
SELECT log_index, event_type, CAST(doc_id % 4 AS INT) AS namespace_id, record_id, node_id, edge_id, CAST(kind AS INT) AS kind, src, dst, key, value FROM e""",
    "diff_events": f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A first line that is new.' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id IS NOT NULL), {_win('o', '(SELECT * FROM documents WHERE doc_id IS NOT NULL)')}, {_win('n', 'e')},
a AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (ORDER BY doc_id, s) - 1 AS record_id, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY s) AS k FROM cko),
b AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY s) AS k FROM ckn)
SELECT 4999 + row_number() OVER (ORDER BY record_id) AS log_index, 'SoftDelete' AS event_type, record_id FROM a ANTI JOIN b USING (doc_id, h, k)""",
    "html_text": f"""WITH h AS (SELECT page_id, regexp_extract(html, '<meta name="author" content="([^"]*)"', 1) AS author, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?si)<(script|style|noscript|title)[^>]*>.*?</(script|style|noscript|title)>', '', 'g'), '<[^>]*>', chr(1), 'g') AS t FROM pages),
p AS (SELECT page_id, author, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> ''), ' ') AS body FROM h)
SELECT page_id, CAST(length(body) AS INT) AS chars, sha256(body) AS digest, nullif(author, '') AS author FROM p""",
    "diff_ingest": f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'One more line that is new.' ELSE text END AS text FROM documents), {_win('o', 'documents')}, {_win('n', 'e')},
c AS (SELECT doc_id, sha256(text) AS h, count(*) FILTER (old) AS a, count(*) FILTER (NOT old) AS b FROM (SELECT doc_id, text, true AS old FROM cko UNION ALL SELECT doc_id, text, false FROM ckn) GROUP BY ALL),
u AS (SELECT doc_id, 'keep' AS action, least(a, b) AS n FROM c UNION ALL SELECT doc_id, 'add', greatest(b - a, 0) FROM c UNION ALL SELECT doc_id, 'remove', greatest(a - b, 0) FROM c)
SELECT doc_id, action, CAST(sum(n) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY ALL""",
    "markdown_text": f"""WITH {_MD}, l AS (SELECT doc_id, i, line, regexp_matches(line, '^#+ ') AS head, {_TRIM.format("regexp_replace(line, '^#+ +', '')")} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md))
SELECT doc_id, arg_min(s, i) FILTER (regexp_matches(line, '^# ')) AS title, CAST(length(string_agg(s, chr(10) ORDER BY i) FILTER (s <> '')) AS INT) AS chars FROM l GROUP BY doc_id""",
    "tree_build": f"WITH {_NODES} SELECT doc_id, node_id, title, level, start_line, end_line, summary, parent FROM tr",
    "tree_rank": f"WITH {_RANK} SELECT * FROM rk",
    "tree_rank_normalised": f"WITH {_RANK} SELECT doc_id, node_id, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS score FROM rk",
    "tree_answer": f"WITH RECURSIVE {_RANK}, bc AS (SELECT doc_id, node_id, title AS breadcrumb FROM tr WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.node_id, bc.breadcrumb || ' > ' || t.title FROM tr t JOIN bc ON bc.doc_id = t.doc_id AND bc.node_id = t.parent), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) AS rank FROM rk) SELECT doc_id, CAST(rank AS INT) AS rank, node_id, score, breadcrumb, start_line, end_line, sha256(own_text) AS evidence_hash FROM k JOIN tr USING (doc_id, node_id) JOIN bc USING (doc_id, node_id) WHERE rank <= 3",
    "tree_hybrid": f"WITH {_R}, {_RANK}, a AS (SELECT doc_id || '/' || node_id AS id, score FROM rk ORDER BY score DESC, id LIMIT 16), b AS (SELECT r.id, {_l2('r.fx', 'q.fx')} / 4294967296.0 AS distance FROM r, (SELECT fx FROM r WHERE id = 0) q ORDER BY distance, r.id LIMIT 16), u AS (SELECT 'tree' AS source, id, 0.6 * score / (SELECT max(score) FROM a) AS score FROM a UNION ALL SELECT 'vector', CAST(id AS VARCHAR), 0.4 * greatest(least(1 - distance / (SELECT max(distance) FROM b), 1), 0) FROM b) SELECT source, id, round(score, 6) AS score FROM u ORDER BY u.score DESC, source, id LIMIT 8",
    "html_title": "SELECT page_id, nullif(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g'), '') AS title FROM pages",
    "format_dispatch": "SELECT page_id, ['html', 'markdown', 'docx', 'pdf', 'text', 'html'][CAST(page_id % 6 + 1 AS INT)] AS format FROM pages",
    "document_validation": "SELECT doc_id, CASE WHEN doc_id % 40 = 1 OR trim(text) = '' THEN 'empty' WHEN strlen(text) > 20000 THEN 'too_large' WHEN doc_id % 30 > 28 THEN 'too_many_pages' WHEN doc_id % 50 = 3 THEN 'protected' END AS error FROM documents",
    "diff_lines": "WITH l AS (SELECT doc_id % 10 AS g, doc_id % 20 < 10 AS old, sha256(x) AS h FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)), c AS (SELECT g, h, count(*) FILTER (old) AS a, count(*) FILTER (NOT old) AS b FROM l GROUP BY g, h), u AS (SELECT g, 'keep' AS action, least(a, b) AS n FROM c UNION ALL SELECT g, 'add', greatest(b - a, 0) FROM c UNION ALL SELECT g, 'remove', greatest(a - b, 0) FROM c) SELECT g AS doc_id, action, CAST(sum(n) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY g, action",
    "batch_insert": "WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 3 > 0 THEN 'r' || (event_id % 700) END AS q FROM events), k AS (SELECT pos FROM r WHERE q IS NULL UNION ALL SELECT min(pos) FROM r WHERE q IS NOT NULL AND CAST(substr(q, 2) AS INT) >= 100 GROUP BY q) SELECT pos, 999 + row_number() OVER (ORDER BY pos) AS id FROM k",
    "encrypted_round_trip": "SELECT item_id AS id, text AS metadata FROM benchmark",
}
