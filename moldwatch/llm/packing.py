"""Operator 1: packing into optimal length buckets.

Sequences longer than ``max_len`` tokens are cut into pieces of at most ``max_len``, so
every token is packed once and the global histogram of piece lengths has at most
``max_len`` rows, whatever the data.  Dynamic programming over that histogram, on the
driver, chooses the bucket boundaries with the least padding.  Inside each bucket
batches of a fixed token budget are formed: every piece is padded to the
bucket's boundary and a batch takes as many as the budget allows.

A piece's number inside its bucket decides its batch.  It comes from two levels,
since one bucket may hold most rows: 4,096 salts (the first digits of the piece's
digest) are counted and summed up, and only the pieces of one bucket and salt are
sorted together.  Equal pieces (same id, number and length) are counted first, ranked as one row
and only then expanded, so a repeated or null id is no larger group than any other.

Defined results: null and negative lengths count as zero; a row of zero tokens has one
piece without bucket or batch; repeated rows are packed each; an empty table gives no rows.
Other columns are ignored.

``pack_texts`` packs content: the same placing over texts by their digests, each distinct text
tokenised once, with every piece's tokens in the result; ``batches`` puts a batch's
pieces together in one row, which the token budget bounds.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.llm.store import written
from moldwatch.llm.text import token_array

MAX_LEN = 4096
N_BUCKETS = 16
BATCH_TOKENS = 65_536
SALT_DIGITS = 3
RUN = 10_000                 # copies of a piece that are expanded together


def optimal_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """The upper boundaries of at most ``n_buckets`` buckets with the least total padding;
    of equal choices, the earliest split.  O(n_buckets * lengths^2), vectorised."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m, k = len(length), min(n_buckets, len(length))
    rows, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(length * count)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    splits = np.zeros((k + 1, m + 1), np.int64)
    for step in range(1, k + 1):
        now = np.full(m + 1, np.iinfo(np.int64).max // 4)
        for i in range(step, m + 1):
            cost = best[:i] + length[i - 1] * (rows[i] - rows[:i]) - (tokens[i] - tokens[:i])
            splits[step, i] = j = int(np.argmin(cost))
            now[i] = cost[j]
        best = now
    bounds, i = [], m
    for step in range(k, 0, -1):
        bounds.append(int(length[i - 1]))
        i = splits[step, i]
    return bounds[::-1]


def _expanded(counted: DataFrame) -> DataFrame:
    """One row per copy, numbered by ``copy`` from 0; what has many copies is dealt out in runs of RUN
    before it is expanded."""
    first = F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)")).alias("first")
    many = counted.filter(F.col("copies") > RUN).select("*", first).repartition("id", "piece", "len", "first")
    runs = counted.filter(F.col("copies") <= RUN).select("*", F.lit(0).cast("bigint").alias("first")).unionByName(many)
    return runs.select("*", F.explode(F.expr(f"sequence(first, least(first + {RUN}, copies) - 1)")).alias("copy"))


def pack(items: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", max_len: int = MAX_LEN,
         n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: ``id_col``, piece, start and n_tokens of the piece, bucket_len (its
    padded length), batch (inside the bucket), slot (inside the batch)."""
    n = F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0))
    pieces = items.select(F.col(id_col).alias("id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("bigint")
    pieces = pieces.select("id", "n", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = written(pieces.select(
        "id", "piece", F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len).cast("bigint")).alias("len"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("piece"))).alias("digest")), "pieces")
    hist = pieces.filter("len > 0").groupBy("len").count().collect()  # at most max_len rows
    bounds = optimal_boundaries([r["len"] for r in hist], [r["count"] for r in hist], n_buckets)
    bucket = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        bucket = F.when(F.col("len") <= b, F.lit(b).cast("bigint")).otherwise(bucket)
    pieces = pieces.select("*", F.when(F.col("len") > 0, bucket).alias("bucket"), F.substring("digest", 1, SALT_DIGITS).alias("salt"))
    pieces = pieces.groupBy("id", "piece", "len", "digest", "bucket", "salt").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("bucket", "salt").agg(F.sum("copies").alias("rows")).select(
        F.col("bucket").alias("b"), F.col("salt").alias("s"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    earlier = Window.partitionBy("bucket", "salt").orderBy("digest", "len", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("copies").over(earlier), F.lit(0))
    ranked = pieces.select("*", inside.alias("nth")).join(  # bounded: buckets * salts
        F.broadcast(offsets), F.col("bucket").eqNullSafe(F.col("b")) & (F.col("salt") == F.col("s")))
    ranked = _expanded(ranked)
    rank = F.col("offset") + F.col("nth") + F.col("copy")
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket")), F.lit(1))
    return ranked.select(F.col("id").alias(id_col), "piece", (F.col("piece") * max_len).alias("start"),
                         F.col("len").alias("n_tokens"), F.col("bucket").alias("bucket_len"),
                         F.when(F.col("bucket").isNotNull(), F.floor(rank / per_batch)).alias("batch"),
                         F.when(F.col("bucket").isNotNull(), rank % per_batch).alias("slot"))


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lengths in words ``[^\\x20\\x09-\\x0D]+``."""
    return docs.select(id_col, F.size(token_array(F.col(text_col))).cast("bigint").alias("n_tokens"))


def subword_ids(tokenizer_path: str) -> Callable[[Column], Column]:
    """Token ids of a text by the tokenizer in a ``.model`` file, for ``pack_texts``."""
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        for t in texts:
            yield t.map(lambda x: model.encode(x, num_threads=1))

    return F.pandas_udf(encode, "array<int>")


def pack_texts(docs: DataFrame, *, text_col: str = "text", tokens: Callable[[Column], Column] = token_array,
               max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece of every text: bucket_len, batch, slot, digest (of the text), piece, n_tokens, tokens.

    Each distinct text is tokenised once; copies are placed each, as ``pack`` places them. Texts
    without tokens (null is the empty text) have no rows; other columns are ignored."""
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("text", F.sha2("text", 256).alias("digest"))
    distinct = d.groupBy("digest").agg(F.first("text").alias("text"))
    distinct = written(distinct.select("digest", tokens(F.col("text")).alias("tokens")), "packed_texts")
    n = F.size("tokens").cast("bigint")
    items = d.select("digest").join(distinct.select("digest", n.alias("n_tokens")), "digest")
    placed = pack(items, id_col="digest", max_len=max_len, n_buckets=n_buckets, batch_tokens=batch_tokens)
    last = F.ceil(n / max_len).cast("bigint") - 1
    pieces = distinct.filter(n > 0).select("digest", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    at = (F.col("piece") * max_len + 1).cast("int")
    pieces = pieces.select("digest", "piece", F.slice("tokens", at, F.lit(max_len)).alias("tokens"))
    return placed.join(pieces, ["digest", "piece"]).select("bucket_len", "batch", "slot", "digest", "piece", "n_tokens", "tokens")


def batches(packed: DataFrame) -> DataFrame:
    """One row per batch of ``pack_texts``: bucket_len, batch, n_rows, n_tokens, n_padding and rows, the pieces'
    (slot, digest, piece, tokens) by slot.  The token budget bounds a group."""
    rows = F.sort_array(F.collect_list(F.struct("slot", "digest", "piece", "tokens")))
    b = packed.groupBy("bucket_len", "batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), rows.alias("rows"))
    return b.select("bucket_len", "batch", "n_rows", "n_tokens",
                    (F.col("n_rows") * F.col("bucket_len") - F.col("n_tokens")).alias("n_padding"), "rows")


def op1_packing(spark, sf_dir):
    """All ``documents`` by their number of words, packed with the production parameters."""
    return pack(word_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    steps = []
    for k in range(1, N_BUCKETS + 1):
        source = "(SELECT 0 AS i, CAST(0 AS HUGEINT) AS cost)" if k == 1 else f"s{k - 1}"
        steps.append(f"""s{k} AS MATERIALIZED (SELECT i, j, cost FROM (SELECT c.i, p.i AS j,
    p.cost + c.len * (c.n - coalesce(q.n, 0)) - (c.t - coalesce(q.t, 0)) AS cost,
    row_number() OVER (PARTITION BY c.i ORDER BY p.cost + c.len * (c.n - coalesce(q.n, 0)) - (c.t - coalesce(q.t, 0)), p.i) AS r
    FROM h c JOIN {source} p ON p.i < c.i LEFT JOIN h q ON q.i = p.i) WHERE r = 1)""")
    every = " UNION ALL ".join(f"SELECT {k} AS k, i, j FROM s{k}" for k in range(1, N_BUCKETS + 1))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
p AS (SELECT doc_id, piece, least(n - piece * {MAX_LEN}, {MAX_LEN}) AS len, md5(concat(doc_id, ':', piece)) AS digest
    FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(CAST(ceil(n / {MAX_LEN}) AS BIGINT) - 1, 0))) AS piece FROM d)),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len) AS i, len, sum(count(*)) OVER (ORDER BY len) AS n,
    sum(len * count(*)) OVER (ORDER BY len) AS t FROM p WHERE len > 0 GROUP BY len),
{", ".join(steps)},
every AS ({every}),
back AS (SELECT least({N_BUCKETS}, (SELECT count(*) FROM h)) AS k, (SELECT max(i) FROM h) AS i
    UNION ALL SELECT back.k - 1, every.j FROM back JOIN every ON every.k = back.k AND every.i = back.i WHERE back.k > 1),
b AS (SELECT h.len AS bound FROM back JOIN h ON h.i = back.i),
r AS (SELECT p.*, (SELECT min(bound) FROM b WHERE bound >= p.len AND p.len > 0) AS bucket FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY digest, len, doc_id) - 1 AS rank,
    greatest({BATCH_TOKENS} // bucket, 1) AS per_batch FROM r)
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(piece * {MAX_LEN} AS BIGINT) AS start, CAST(len AS BIGINT) AS n_tokens,
    CAST(bucket AS BIGINT) AS bucket_len, CAST(CASE WHEN bucket IS NOT NULL THEN rank // per_batch END AS BIGINT) AS batch,
    CAST(CASE WHEN bucket IS NOT NULL THEN rank % per_batch END AS BIGINT) AS slot FROM n
"""


OP1_SQL = _sql()
