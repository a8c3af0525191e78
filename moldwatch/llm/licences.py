"""Operator 5: licence scan with a positional rare-token index.

Templates (short licence phrases and notices, a parameter) are indexed by their
rarest words: rarity is the inverse document frequency over all scanned files.
For each template the index keeps just as many of its highest-IDF words, with
their relative positions, as any sufficient match must contain one of.  Looking
up a file's words gives candidate starts (word place minus relative position);
at each start the template's postings are intersected with the file by relative
position, and the matched share of IDF weight decides.  A template also has a
mandatory key phrase that must stand in full at its place.

Two scans, no shuffle of texts: files without an index word contribute one row,
others only their matches.

Defined results: null, empty and word-less texts have no words and no labels;
repeated rows are reported once each; an empty table gives no rows.  Other
columns are ignored, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.text import word_array


@dataclass(frozen=True)
class Template:
    label: str
    words: str          # the template's words, separated by spaces
    key: str            # mandatory key phrase, part of ``words``
    share: float = 0.8  # least matched share of the template's IDF weight
    base: bool = False  # a base phrase: exact


BASE = [
    Template("gpl", "gnu general public license", "gnu general public license", 1.0, True),
    Template("apache", "apache license", "apache license", 1.0, True),
    Template("cc-by", "cc by", "cc by", 1.0, True),
    Template("mit", "mit license", "mit license", 1.0, True),
]
NOTICES = [
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]
MICRO = 1_000_000


def document_frequency(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and for each vocabulary word the files that hold it."""
    own = F.array_intersect(word_array(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = (docs.select(F.explode_outer(F.concat(own, F.array(F.lit("")))).alias("word"))
            .groupBy("word").count().collect())  # one row per vocabulary word at most
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def build_index(templates: list[Template], n_docs: int, df: dict[str, int]) -> list[tuple]:
    """Postings (word, rel, template number, label, base, words, weights, least
    weight, key place, key words): each template under the words that any
    sufficient match must contain one of."""
    postings = []
    for number, t in enumerate(templates):
        words = t.words.split(" ")
        weights = [round(math.log(1 + n_docs / (1 + df.get(w, 0))) * MICRO) + 1 for w in words]
        total = sum(weights)
        least = total if t.share >= 1 else math.ceil(total * t.share)
        key = t.key.split(" ")
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        left = total
        for rel in sorted(range(len(words)), key=lambda i: (-weights[i], i)):
            postings.append((words[rel], rel, number, t.label, t.base, words, weights, total, least, at, key))
            left -= weights[rel]
            if left < least:
                break
    return postings


POSTING = ("word string, rel int, template int, label string, base boolean, twords array<string>, "
           "weights array<bigint>, total bigint, least_weight bigint, key_at int, key array<string>")


def _slice(words: Column, start: Column, length: Column) -> Column:
    return F.slice(words, F.greatest(start, F.lit(0)) + 1, length)


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None) -> DataFrame:
    """One row per document: ``id_col``, n_words and matches, a sorted array of distinct
    (start, template, label, base, score)."""
    spark = docs.sparkSession
    templates = BASE + NOTICES if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t.words.split(" ")})
    n_docs, df = document_frequency(docs, text_col, vocabulary)
    postings = build_index(templates, n_docs, df)
    index = spark.createDataFrame(postings, POSTING)
    anchors = F.array(*map(F.lit, sorted({p[0] for p in postings})))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"),
                    word_array(F.col(text_col)).alias("words"))
    n = F.size("words")
    places = F.when(F.arrays_overlap("words", anchors), F.sequence(F.lit(0), n)).otherwise(F.array(n))
    d = d.select("id", "print", "words", n.alias("n"), F.explode_outer(places).alias("pos"))
    d = d.withColumn("at_word", F.get("words", F.col("pos")))
    start = F.col("pos") - F.col("rel")
    fits = (start >= 0) & (start + F.size("twords") <= F.col("n"))
    key_there = _slice(F.col("words"), start + F.col("key_at"), F.size("key")) == F.col("key")
    found = d.join(F.broadcast(index), (F.col("at_word") == F.col("word")) & fits & key_there, "left").filter(
        F.col("template").isNotNull() | (F.col("pos") == F.col("n")))
    weight = F.aggregate(
        F.arrays_zip(_slice(F.col("words"), start, F.size("twords")).alias("w"), F.col("twords").alias("t"),
                     F.col("weights").alias("x")),
        F.lit(0).cast("bigint"), lambda a, z: a + F.when(z["w"] == z["t"], z["x"]).otherwise(0))
    found = found.select("id", "print", "n", "template", "label", "base", "total", "least_weight", "pos",
                         start.alias("start"), F.when(F.col("template").isNotNull(), weight).alias("weight"))
    good = F.col("template").isNotNull() & (F.col("weight") >= F.col("least_weight"))
    match = F.struct("start", "template", "label", "base",
                     F.round(F.col("weight") / F.col("total"), 6).alias("score"))
    per_doc = found.groupBy("id", "print", "n").agg(
        F.sum(F.when(F.col("template").isNull() & (F.col("pos") == F.col("n")), 1).otherwise(0)).alias("copies"),
        F.sort_array(F.collect_set(F.when(good, match))).alias("matches"))
    one_each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return (per_doc.select("*", one_each.alias("copy"))
            .select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), "matches"))


def op5_licences(spark, sf_dir):
    """Contract query: licences of all ``documents``."""
    d = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("bigint"))

    def labels(of):
        return F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(of, lambda m: m["label"]))))

    return d.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
                    F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                    labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                    F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))


def oracle(templates: list[Template]) -> str:
    """The same result in SQL, by comparing every template at every word."""
    rows = ",\n".join(f"({i}, '{t.label}', {t.share}, {t.base}, '{t.key}', "
                      f"{len(t.words[:t.words.index(t.key)].split())}, {len(t.key.split())}, {t.words.split(' ')!r})"
                      for i, t in enumerate(templates))
    return rf"""
WITH t(template, label, share, base, key, key_at, key_n, words) AS (VALUES {rows}),
tw AS (SELECT template, unnest(words) AS w, unnest(generate_series(0, len(words) - 1)) AS rel FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(0, len(w) - 1)) AS pos FROM d),
idf AS (SELECT v.w, CAST(round(ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(DISTINCT dw.doc_id))) * 1000000) AS BIGINT) + 1 AS x
    FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN dw ON dw.w = v.w GROUP BY v.w),
total AS (SELECT template, CAST(sum(x) AS BIGINT) AS total FROM tw JOIN idf USING (w) GROUP BY template),
c AS (SELECT doc_id, template, pos - rel AS start, CAST(sum(x) AS BIGINT) AS weight
    FROM dw JOIN tw ON dw.w = tw.w JOIN idf ON idf.w = tw.w GROUP BY ALL),
m AS (SELECT c.doc_id, c.start, t.template, t.label, t.base, round(c.weight / total.total, 6) AS score
    FROM c JOIN t USING (template) JOIN total USING (template) JOIN d USING (doc_id)
    WHERE c.start >= 0 AND c.start + len(t.words) <= len(d.w)
      AND c.weight >= CASE WHEN t.share >= 1 THEN total.total ELSE ceil(total.total * CAST(t.share AS DOUBLE)) END
      AND array_to_string(list_slice(d.w, c.start + t.key_at + 1, c.start + t.key_at + t.key_n), ' ') = t.key),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word, max(score) AS score FROM m GROUP BY doc_id),
lb AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM m) GROUP BY doc_id),
bb AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM m WHERE base) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
    CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(bb.labels, '') AS base_labels, coalesce(lb.labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN lb USING (doc_id) LEFT JOIN bb USING (doc_id)
"""


OP5_SQL = oracle(BASE + NOTICES)
