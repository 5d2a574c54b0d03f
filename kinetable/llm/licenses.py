"""License scans with a positional index of rare licence words; DataFrame functions only.

Templates are short licence statements of which a part, the key phrase, is mandatory.  Document frequencies of all
template words are counted over the whole corpus; the two rarest words of each key phrase are the template's
entries in the index (word -> template, offset).  A file's words are looked up in this index; a hit of a word at place p stands for
a template that starts at p - offset.  Starts on which both rare words agree are candidates, as no place of the key phrase can
lack one of them; the key phrase is then verified word by word, and the candidate's score is the share of the
template's inverse document frequency found at the expected places.

Nothing is shuffled but the frequencies of the template words, and nothing else reaches the driver.

Edge cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; words that are
equally rare are taken in the order of the template; extra columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, query, table, two_columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words on whose relative position a candidate must agree.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    key: str
    before: str = ""
    after: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return f"{self.before} {self.key} {self.after}".split()

    @property
    def keys(self) -> range:
        first = len(self.before.split())
        return range(first, first + len(self.key.split()))


TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("agpl-3", "gnu affero general public license", "licensed under the", "version 3"),
    Template("bsd", "redistribution and use in source and binary forms", "", "with or without modification are permitted"),
    Template("cc-by-sa", "cc by sa", "licensed under"),
    Template("gpl-2", "gnu general public license version 2", "this work is licensed under the"),
    Template("gpl-3", "gnu general public license version 3", "this work is licensed under the"),
    Template("isc", "permission to use copy modify and or distribute this software", "", "for any purpose"),
    Template("lgpl", "gnu lesser general public license", "licensed under the", "version"),
    Template("mit-text", "permission is hereby granted free of charge", "", "to any person obtaining a copy of this software"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the", "v 2 0"),
    Template("unlicense", "free and unencumbered software", "this is", "released into the public domain"),
)


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of a fixed vocabulary (which bounds the rows collected)."""
    known = F.array_append(F.array_intersect("_words", F.array(*map(F.lit, vocabulary))), F.lit(""))
    rows = words.select(F.explode(known).alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in rows}
    return often.pop("", 0), often


def _candidates(template: Template, idf: dict[str, float], order: list[int]) -> Column:
    """Candidates of one template from the hits of index words, with verified key phrase and score."""
    words, anchors = template.words, order[:ANCHORS]

    def starts(j: int) -> Column:
        return F.transform(F.filter("_hits", lambda h: h["w"] == words[j]), lambda h: h["i"] - j)

    common = starts(anchors[0])
    for j in anchors[1:]:
        common = F.array_intersect(common, starts(j))
    total = sum(idf[w] for w in words)

    def judged(s: Column) -> Column:
        equal = [F.coalesce(F.get("_words", s + j) == w, F.lit(False)) for j, w in enumerate(words)]
        whole = equal[template.keys[0]]
        for j in template.keys[1:]:
            whole = whole & equal[j]
        found = F.lit(0.0)
        for e, w in zip(equal, words, strict=True):
            found = found + F.when(e, F.lit(idf[w])).otherwise(F.lit(0.0))
        return F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), s.alias("start"), whole.alias("whole"), (found / total).alias("score"))

    return F.transform(common, judged)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words and places (label, base, start, whole, score) of all candidates."""
    split = two_columns(docs, key, text).select("_id", F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(WORD), F.lit(0)).alias("_words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    count, often = document_frequencies(split, vocabulary)
    idf = {w: math.log((count + 1) / (often.get(w, 0) + 1)) + 1.0 for w in vocabulary}
    order = {t: sorted(t.keys, key=lambda j: (often.get(t.words[j], 0), j)) for t in templates}
    index = sorted({t.words[j] for t in templates for j in order[t][:ANCHORS]})
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(index), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    found = split.withColumn("_hits", hits)
    places = F.flatten(F.array(*[_candidates(t, idf, order[t]) for t in templates]))
    places = F.when(F.size("_hits") > 0, places).otherwise(F.filter(places, lambda p: F.lit(False)))
    return found.select(F.col("_id").alias("doc_id"), F.size("_words").cast("long").alias("n_words"), places.alias("places"))


def label_list(places: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))


def summarised(scanned: DataFrame) -> DataFrame:
    whole = scanned.withColumn("_whole", F.filter("places", lambda p: p["whole"])).withColumn("_base", F.filter("_whole", lambda p: p["base"]))
    starts = F.transform("_base", lambda p: p["start"].cast("long"))
    return whole.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label_list(F.col("_base")).alias("base_labels"), label_list(F.col("_whole")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)), 6).alias("score"),
    )


def _template_rows() -> str:
    rows = []
    for t, x in enumerate(TEMPLATES):
        rows += [f"({t}, '{x.label}', {x.base}, {j}, '{w}', {j in x.keys})" for j, w in enumerate(x.words)]
    return ", ".join(rows)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t(t, label, base, j, word, is_key) AS (VALUES {_template_rows()}),
p AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
f AS (SELECT word, count(DISTINCT r) AS n FROM p WHERE word IN (SELECT word FROM t) GROUP BY word),
x AS (SELECT t.*, coalesce(f.n, 0) AS n, ln(((SELECT count(*) FROM d) + 1.0) / (coalesce(f.n, 0) + 1)) + 1 AS idf FROM t LEFT JOIN f USING (word)),
a AS (SELECT *, is_key AND row_number() OVER (PARTITION BY t, is_key ORDER BY n, j) <= {ANCHORS} AS anchor FROM x),
s AS (SELECT t, sum(idf) AS idf, count(*) FILTER (WHERE is_key) AS keys, count(*) FILTER (WHERE anchor) AS anchors FROM a GROUP BY t),
m AS (SELECT r, a.t, any_value(label) AS label, any_value(base) AS base, i - j AS start, sum(a.idf) AS idf, count(*) FILTER (WHERE is_key) AS keys, count(*) FILTER (WHERE anchor) AS anchors
      FROM p JOIN a USING (word) GROUP BY r, a.t, i - j),
c AS (SELECT r, label, base, start, m.keys = s.keys AS whole, m.idf / s.idf AS score FROM m JOIN s USING (t) WHERE m.anchors = s.anchors),
g AS (SELECT r, count(*) FILTER (WHERE whole AND base) AS n_base, min(start) FILTER (WHERE whole AND base) AS first_word, max(start) FILTER (WHERE whole AND base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS labels, max(score) AS score
      FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN g USING (r)
"""


@query("op1_licenses", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(scan_licenses(table(spark, sf_dir, "documents")))
