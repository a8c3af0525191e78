"""A training-data pipeline over ``documents``: language ID, quality rules, near-duplicate
removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``docs`` unchanged, whatever these are called.  Rows equal in id
and text are copies of each other.

* language: texts whose language cannot be told go (``und`` or too near a runner-up).
* quality: documents that fail the quality policy go.
* near_duplicates: of each class the document with the smallest id stays.
* decontaminate: documents that hold a benchmark window go.
* pack: one row per packed piece (see ``moldwatch.llm.packing``).

No stage needs a column but doc_id, text and, to learn languages, lang; an empty table passes as
an empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moldwatch.llm import decontam, langid, near_dup, packing, quality
from moldwatch.llm.store import written

ORACLE_SQL = None  # compression and minhash have no SQL; tests/llm holds the stages against brute force


def _rows(annotated: DataFrame, names: list[str]) -> DataFrame:
    return annotated.select(*(F.col("row")[c].alias(c) for c in names))


def _key(doc_id: Column, text_print: Column) -> Column:
    """Never null: tells documents apart by id and text."""
    return F.concat_ws(":", text_print, doc_id.cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       _key(F.col("doc_id"), F.xxhash64("text")).alias("key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told stay; null, empty and letterless texts are ``und`` and go, a very long
    text is judged whole, equal rows fare alike."""
    learned = langid.fit_dictionaries(docs.filter(langid.fold(F.col("doc_id"), 4) != 2))
    return _rows(langid.annotate(docs, learned).filter(~F.col("found.rejected")), docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the policy stay; null, empty and short texts fail, a very long
    text is measured whole, equal rows fare alike."""
    mask = quality.BASE_MASK | quality.POLICIES[quality.POLICY]
    return _rows(quality.ledger(docs).filter(quality.passes(F.col("ledger.fail_bits"), mask)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies stays, that of the smallest id (null ids last); null and wordless
    texts are in no class and differ by id and text, equal rows become one."""
    classes = near_dup.near_duplicates(docs)
    group = F.coalesce(F.col("root"), F.encode(_key(F.col("doc_id"), F.col("print")), "utf-8"))  # no words: alone
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print"))
    kept = classes.groupBy(group.alias("group")).agg(first.alias("k")).select(_key(F.col("k.doc_id"), F.col("k.print")).alias("key"))
    one = _keyed(docs).join(kept.distinct(), "key", "left_semi").dropDuplicates(["key"])
    return _rows(one, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay, whatever their length; null and wordless texts hold none,
    and without benchmark texts all stay."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    hit = found.select(_key(F.col("doc_id"), F.col("print")).alias("key")).distinct()
    return _rows(_keyed(docs).join(hit, "key", "left_anti"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most the maximal length, so a very long text is several; null and empty texts are one
    empty piece without a batch, equal rows are packed each."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
