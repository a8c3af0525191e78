"""Operator 3: benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes item-sized windows: runs of ``window`` words (one
shorter run where the item has fewer).  A document contains a window exactly if
it contains all its shingles at the right places, so one shingle per window is
a necessary prefix: with shingles ordered by how often they occur in all
documents, the rarest is joined.  Windows whose rarest shingle never occurs
leave before the join.  A joined position survives the length and positional
bounds (the window must fit around it) and the comparison of all its words.

The documents are scanned twice for each block (frequencies, join) and never shuffled; only
matches and one row per document are.  Distinct windows are broadcast in blocks of
about ``block_windows`` (dealt by their digest, so evenly) and, for the frequencies, at most eight
times as many shingle keys; the items of a window are joined to its matches afterwards, so
neither grows with the number of items that share a window.

Defined results: null and word-less texts have no words and no hits; null item
texts have no windows; a null item_id marks words as hit but is not listed or
counted; repeated item ids count once; repeated documents are reported once per
row; empty tables give no rows, an empty benchmark no hits.  Other columns of
either table are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.store import written
from moldwatch.llm.text import word_array

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 500_000


def _shingle_key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): every distinct item-sized window of every item."""
    words = items.select(F.col(item_col).cast("string").alias("item"),
                         word_array(F.col(text_col)).alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window)))
    return (words.select("item", "words", F.explode_outer(starts).alias("start"))
            .filter(F.col("start").isNotNull())
            .select("item", F.slice("words", F.col("start") + 1, F.lit(window)).alias("win"))
            .distinct())


def _positions(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], marks: bool) -> DataFrame:
    """One row per document word (and shingle size) with its shingle key; with ``marks``
    also one row per document at ``pos = n`` whose key is null."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"),
                    word_array(F.col(text_col)).alias("words"))
    d = d.select("id", "print", "words", F.size("words").alias("n"),
                 F.explode_outer(F.sequence(F.lit(0), F.size("words"))).alias("pos"))
    keys = [_shingle_key(F.col("words"), F.col("pos"), s) for s in sizes]
    if len(keys) == 1:
        d = d.withColumn("key", F.when(F.col("pos") < F.col("n"), keys[0]))
    else:
        d = d.withColumn("key", F.explode_outer(F.when(F.col("pos") < F.col("n"), F.array(*keys))))
    return d if marks else d.filter("pos < n")


def _postings(windows: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, list[int]]:
    """(key, off, win): each window under its rarest shingle."""
    size = F.least(F.size("win"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())  # at most `shingle` values
    if not sizes:
        sizes = [shingle]
    at = windows.select("win", F.explode_outer(F.sequence(F.lit(0), F.size("win") - size)).alias("off"))
    key = F.lit(None).cast("bigint")
    for s in sizes:
        key = F.when(size == s, _shingle_key(F.col("win"), F.col("off"), s)).otherwise(key)
    at = at.withColumn("key", key)
    seen = (_positions(docs, id_col, text_col, sizes, marks=False).select("key")
            .join(F.broadcast(at.select("key").distinct()), "key")
            .groupBy("key").agg(F.count(F.lit(1)).alias("freq")))
    first = at.join(seen, "key", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "off")).alias("m"))
    return first.filter("m.freq > 0").select("m.key", "m.off", "win"), sizes


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: ``id_col``, print (xxhash64 of its text), n_words, spans (distinct [start, end) of the
    occurring windows, sorted), n_hit (words inside them) and items (sorted)."""
    windows = written(item_windows(items, item_col, item_text_col, window), "windows")
    distinct = written(windows.select("win").distinct(), "distinct")
    blocks = max(1, -(-distinct.count() // block_windows))
    found = None
    for b in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b) if blocks > 1 else distinct
        postings, sizes = _postings(part, docs, id_col, text_col, shingle)
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.size("win") <= F.col("n"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")
        d, p = _positions(docs, id_col, text_col, sizes, marks=True), written(postings, "postings")
        p = p.withColumnRenamed("key", "item_key")
        hits = (d.join(F.broadcast(p), (d.key == p.item_key) & fits & same, "left")
                .filter(F.col("win").isNotNull() | ((F.col("pos") == F.col("n")) & F.lit(b == 0)))
                .select("id", "print", "n", "win",
                        F.when(F.col("win").isNull(), 1).otherwise(0).alias("mark"),
                        F.when(F.col("win").isNotNull(), F.struct(
                            start.alias("start"), (start + F.size("win")).alias("end"))).alias("span")))
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "found")
    doc = ["id", "print", "n"]
    owners = found.filter(F.col("win").isNotNull()).select(*doc, "win").distinct().join(windows, "win").select(*doc, "item").distinct()
    both = found.select(*doc, "mark", "span").unionByName(owners.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    per_doc = both.groupBy(*doc).agg(
        F.sum("mark").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("words"),
                              F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["words"])
    one_each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return (per_doc.select("*", one_each.alias("copy"))
            .select(F.col("id").alias(id_col), "print", F.col("n").cast("bigint").alias("n_words"), "spans",
                    covered.cast("bigint").alias("n_hit"), "items"))


def op3_decontaminate(spark, sf_dir):
    """Contract query: contamination of all ``documents`` by all ``benchmark`` items."""
    d = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, least(len(w), 10) AS k
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, k WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
    (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
