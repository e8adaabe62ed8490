"""Licence scans with a positional rare-token index; DataFrame functions only, no shuffle of texts.

Templates are word sequences, from phrases to whole licence texts, with a label and mandatory key phrases.  The index
maps every template word but function words to its postings: (template, offset).  One pass over the documents counts in
how many of them each template word stands (a result as large as the templates' vocabulary).

A document looks up its ``RARE`` licence words of highest inverse document frequency, and always those of the base
phrases.  Places of these words less the offsets of their postings are places where a template may start; those that
two postings or more agree on are verified word by word.  A template is present if all of its words stand there, or, if
it has ``LONG`` words or more, if a share of ``ENOUGH`` of their weight does and its key phrases stand at their place.
The score is the largest share of any template's weight at a verified place.  Every step is one expression over all
templates, so more templates make the index larger and not the plan.

Words are lower-cased in A-Z only and are runs of letters, digits and non-ASCII characters, numbered from 0.

Defined results: a null or empty text has no words, no places, null first and last word, empty labels and score 0;
every input row gives one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, LONG, ENOUGH = 12, 8, 0.8
#: Words that say nothing about a licence; they are verified, but never looked up.
FUNCTION_WORDS = frozenset("a all an and any are as at be but by for from has have in is it its may not of on or see that the this to under was will with you your".split())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool = False
    keys: tuple[tuple[str, ...], ...] = field(default=())

    def mandatory(self) -> frozenset[int]:
        """Offsets of the key phrases' words; a phrase stands at its first place in the template."""
        out: set[int] = set()
        for k in self.keys:
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)
            out |= set(range(at, at + len(k)))
        return frozenset(out)


def _t(label: str, text: str, *keys: str, base: bool = False) -> Template:
    return Template(label, tuple(text.split()), base, tuple(tuple(k.split()) for k in keys))


BASE = (_t("mit", "mit license", base=True), _t("apache", "apache license", base=True), _t("gpl", "general public license", base=True))

_FREE = "is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation either version 3 of the license or at your option any later version"

#: Phrases, notices and texts of well-known licences beyond the base ones.
OWN = (
    _t("agpl", "this program " + _FREE.format("gnu affero general public license"), "gnu affero general public license"),
    _t("agpl", "gnu affero general public license"),
    _t("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "licensed under the apache license"),
    _t("apache", "licensed under the apache license version 2 0", "apache license"),
    _t("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "person or organization obtaining a copy"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    _t("cc-by-nc", "licensed under cc by nc"),
    _t("cc-by", "creative commons attribution"),
    _t("gpl", "this program " + _FREE.format("gnu general public license"), "gnu general public license"),
    _t("gpl", "licensed under the gnu general public license", "general public"),
    _t("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    _t("lgpl", "this library " + _FREE.format("gnu lesser general public license"), "gnu lesser general public license"),
    _t("lgpl", "lesser general public license"),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "to deal in the software without restriction"),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge", "this software"),
    _t("mit", "released under the mit license", "mit"),
    _t("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    _t("mpl", "mozilla public license"),
    _t("proprietary", "all rights reserved"),
    _t("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "released into the public domain"),
    _t("unlicense", "released into the public domain"),
    _t("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "alter it and redistribute it freely"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many rows each word of the vocabulary stands, and the rows; the result is bounded by the vocabulary."""
    every = F.array(*map(F.lit, vocabulary))
    counts = words.select(F.explode(F.array_append(F.array_intersect("words", every), "")).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}  # the empty word stands once in every row
    return {w: found.get(w, 0) for w in vocabulary}, found.get("", 0)


def idf(df: int, rows: int) -> float:
    return math.log((rows + 1) / (df + 1)) + 1


def index_words(templates: tuple[Template, ...]) -> list[str]:
    """The words that are looked up: all of the base phrases, else those that are no function words."""
    base = {w for t in templates if t.base for w in t.words}
    return sorted(base | {w for t in templates for w in t.words} - FUNCTION_WORDS)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + OWN, rare: int = RARE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    worded = docs.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    df, rows = document_frequencies(worded.select("words"), vocabulary)
    ordered = sorted(index_words(templates), key=lambda w: (df[w], w))
    always = sorted({w for t in templates if t.base for w in t.words})
    posts: dict[str, list[Column]] = {w: [] for w in ordered}
    for k, t in enumerate(templates):
        for j, w in enumerate(t.words):
            if w in posts:
                posts[w].append(F.struct(F.lit(k).cast("long").alias("t"), F.lit(j).alias("j")))
    index = F.create_map(*(c for w, p in posts.items() for c in (F.lit(w), F.array(*p))))
    weights = [[idf(df[w], rows) for w in t.words] for t in templates]
    whole = F.array(*(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x).alias("x"), F.lit(j in t.mandatory()).alias("key")) for j, (w, x) in enumerate(zip(t.words, own, strict=True)))) for t, own in zip(templates, weights, strict=True)))
    facts = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words) >= LONG).alias("long"), F.lit(sum(own)).alias("total")) for t, own in zip(templates, weights, strict=True)))

    top = F.slice(F.array_intersect(F.array(*map(F.lit, ordered)), F.col("words")), 1, rare)
    look = F.array_union(top, F.array_intersect(F.array(*map(F.lit, always)), F.col("words")))
    looked = worded.withColumn("look", look)
    located = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(F.col("look"), h["w"]))
    step = 1 << 32
    near = F.flatten(F.transform(located, lambda h: F.transform(F.filter(F.element_at(index, h["w"]), lambda p: p["j"] <= h["i"]), lambda p: p["t"] * step + h["i"] - p["j"])))
    placed = looked.withColumn("starts", F.when(F.size("look") > 0, F.array_sort(near)).otherwise(F.array().cast("array<long>")))
    # two postings agree where a start stands twice
    agreed = placed.withColumn("starts", F.array_distinct(F.filter("starts", lambda s, k: s == F.get(F.col("starts"), k + 1))))
    parts = agreed.withColumn(
        "parts",
        F.transform("starts", lambda c: F.struct(
            F.get(facts, (c / step).cast("int")).alias("f"), (c % step).cast("int").alias("s"),
            F.transform(F.get(whole, (c / step).cast("int")), lambda p, j: F.struct(F.get(F.col("words"), (c % step).cast("int") + j).eqNullSafe(p["w"]).alias("ok"), p["x"].alias("x"), p["key"].alias("key"))).alias("p"),
        )),
    )
    found = parts.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.transform("parts", lambda v: F.struct(
            v["f"].alias("f"), v["s"].alias("s"), F.forall(v["p"], lambda p: p["ok"]).alias("all"), F.forall(v["p"], lambda p: p["ok"] | ~p["key"]).alias("keys"),
            (F.aggregate(v["p"], F.lit(0.0), lambda a, p: a + F.when(p["ok"], p["x"]).otherwise(0.0)) / v["f"]["total"]).alias("share"),
        )).alias("found"),
    )
    base = found.withColumn("base", F.filter("found", lambda v: v["f"]["base"] & v["all"])).withColumn("at", F.transform("base", lambda v: v["s"]))

    def named(rows_: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows_, lambda v: v["f"]["label"]))), ",")

    return base.select(
        F.col("id").alias(id_col), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        named(F.col("base")).alias("base_labels"), named(F.filter("found", lambda v: v["all"] | (v["f"]["long"] & v["keys"] & (v["share"] >= ENOUGH)))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda v: v["share"])), F.lit(0.0)), 6).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = BASE + OWN, rare: int = RARE) -> str:
    """The same result in SQL, from the same index."""
    index = set(index_words(templates))
    always = {w for t in templates if t.base for w in t.words}
    words = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {j}, '{w}', {str(j in t.mandatory()).lower()}, {str(w in index).lower()}, {str(w in always).lower()})" for k, t in enumerate(templates) for j, w in enumerate(t.words))
    return f"""
WITH tpl(t, label, base, j, w, key, indexed, always) AS (VALUES {words}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
hit AS (SELECT * FROM p WHERE w IN (SELECT w FROM tpl)),
df AS (SELECT v.w, bool_or(v.indexed) AS indexed, bool_or(v.always) AS always, count(DISTINCT h.r) AS df FROM (SELECT DISTINCT w, indexed, always FROM tpl) v LEFT JOIN hit h USING (w) GROUP BY v.w),
n AS (SELECT count(*) AS n FROM documents),
weight AS (SELECT t, label, base, j, w, key, tpl.indexed, ln((n.n + 1) / (df.df + 1)) + 1 AS x, count(*) OVER (PARTITION BY t) AS size FROM tpl JOIN df USING (w), n),
total AS (SELECT t, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size, sum(x) AS total FROM weight GROUP BY t),
look AS (SELECT r, w FROM (SELECT r, w, always, row_number() OVER (PARTITION BY r ORDER BY df, w) AS k FROM (SELECT DISTINCT r, w FROM hit) JOIN df USING (w) WHERE indexed) WHERE k <= {rare} OR always),
start AS (SELECT h.r, g.t, h.i - g.j AS s FROM hit h JOIN look USING (r, w) JOIN weight g ON h.w = g.w AND g.indexed WHERE h.i >= g.j GROUP BY ALL HAVING count(*) > 1),
part AS (SELECT s.r, s.t, s.s, sum(CASE WHEN h.w IS NULL THEN 0 ELSE g.x END) AS got, bool_and(h.w IS NOT NULL) AS whole, bool_and(h.w IS NOT NULL OR NOT g.key) AS keys FROM start s JOIN weight g ON g.t = s.t LEFT JOIN hit h ON h.r = s.r AND h.i = s.s + g.j AND h.w = g.w GROUP BY ALL),
seen AS (SELECT part.r, part.t, label, base, s, CASE WHEN whole THEN 1.0 ELSE got / total END AS share, whole, keys, size FROM part JOIN total USING (t)),
agg AS (SELECT r, count(*) FILTER (base AND whole) AS n_base, min(s) FILTER (base AND whole) AS first_word, max(s) FILTER (base AND whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR (share >= {ENOUGH} AND size >= {LONG} AND keys)) AS labels, max(share) AS score FROM seen GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CAST(coalesce(score, 0.0) AS DOUBLE), 6) AS score FROM d LEFT JOIN agg USING (r)"""
