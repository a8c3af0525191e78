"""Operator 2: token counts with a digest cache.

The cache is a table (tokenizer digest, content digest, n_tokens).  Documents are
reduced to the digests of their normalised content, each distinct content once;
those found in the cache for this tokenizer version are not encoded, the others are
encoded in Arrow batches and appended.  The counts then come from the cache.

Copies collapse on the map side before texts are shuffled, so a group of copies is
one row per map task at most; the last join is on digests, which AQE splits
when one is hot.  A failed run leaves a cache without its rows or, after the append,
with them: both are right, and repeated cache rows count once.

Normalisation must not change a count.  For ``piece_bpe_32k.model``, whose own normaliser is
the identity, that leaves null as the empty text (``as_is``).

Defined results: null is the empty text (0 tokens); repeated rows are counted each;
an empty table gives no rows and leaves the cache as it is.  Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.store import shared_path

CONTEXT = 4096
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def load_tokenizer(path: str) -> Callable[[str], int]:
    """Number of tokens of a text by the library for this kind of file."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: library, its release and the file's content."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def as_is(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _cached(spark, cache_path: str, version: str) -> DataFrame | None:
    """Digests and counts stored for a tokenizer version; None without a cache."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] = as_is) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens.  Adds what was missing to the cache."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = normalise(F.col(text_col))
    d = docs.select(F.col(id_col).alias("id"), content.alias("text")).select(
        "id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    missing = d.groupBy("digest").agg(F.first("text").alias("text"))
    known = _cached(spark, cache_path, version)
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")

    def encode(batches):
        count = load_tokenizer(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array([count(t.as_py()) for t in b.column("text")], pa.int64())], ["digest", "n_tokens"])

    counted = missing.mapInArrow(encode, "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return (d.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
            .join(_cached(spark, cache_path, version), "digest")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens"))


def op2_token_counts(spark, sf_dir):
    """Contract query: all ``documents``, starting from an empty cache."""
    import public_tokenizers
    c = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "token_cache"),
                     public_tokenizers.path("piece_bpe_32k.model"))
    return c.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))
