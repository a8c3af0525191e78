"""Operator 12: importance resampling towards a target distribution.

Features are hashed n-grams of words.  With S features of the corpus, s of them in a
bucket, and T and t of the target, a bucket's gain is the log ratio of its smoothed target and
corpus shares; a document's weight is its mean gain.  Gumbel noise from a digest of seed and id is
added to the weight, and the documents with the highest sums are a sample without replacement
in proportion to exp(weight / 1000).

Features come from Arrow kernels on whole batches: ascii_lower, split_pattern_regex,
list_flatten and dictionary_encode number the words; a shifted copy of the numbers makes
n-grams, each distinct one is hashed once with CRC-32; ``take`` fetches gains, which a
segmented sum reduces to documents.  Tasks send bucket counts, never words.

Ranks need no window over all rows: scores are whole numbers, so their histogram (bounded by the
range of scores, not by the corpus) gives the lowest drawn score and every score's first rank,
and only drawn rows are ordered, inside one score.  Equal rows are counted before they are ordered.

Defined results: null and wordless texts have no features and weight 0; null ids count as
the empty string for the noise and come last among ties; equal rows get consecutive ranks; an
empty corpus gives no rows, an empty target only smoothing; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.llm.store import written

N = 1                # words of the longest feature
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
SLICE = 4 << 20      # bytes of text worked on at a time (a longer text alone)
RUN = 10_000         # copies of a row that are expanded together
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def slices(batch: pa.RecordBatch, text: int):
    """Consecutive parts of a batch whose texts take at most SLICE bytes (or hold one row)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of 1 to ``n`` words, and the words of each text."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: the kernels misread a slice's offset
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern_regex(pc.ascii_lower(whole), pattern=SEPARATORS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)  # a leading or trailing separator leaves an empty word
    words, owner = words.filter(some), owner.filter(some).to_numpy().astype(np.int64)
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in spelled], np.int64)  # of each distinct gram so far
    found, owners, gram, last, place = [], [], number, spelled, owner
    for length in range(1, n + 1):
        if length > 1:  # a gram and the word after it, where both are of one text
            k = len(number) - length + 1
            if k <= 0:
                break
            pair = gram[:k] * len(spelled) + number[length - 1:]
            distinct, gram = np.unique(pair, return_inverse=True)
            last = [last[p // len(spelled)] + b" " + spelled[p % len(spelled)] for p in distinct.tolist()]
            crc = np.array([zlib.crc32(g) for g in last], np.int64)
            inside = owner[:k] == owner[length - 1:]
        else:
            inside = np.ones(len(gram), bool)
        found.append((crc[gram] % buckets)[inside] if len(gram) else np.zeros(0, np.int64))
        owners.append(place[:len(gram)][inside])
    return np.concatenate(found), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def bucket_counts(df: DataFrame, text_col: str, n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b, 0):
                total += np.bincount(features(part.column(0), n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "c"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket bigint, c bigint")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # at most a row per bucket
        out[r["bucket"]] = r["c"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)*(S+B) / ((s+1)*(T+B)))) of each of the B buckets."""
    b = len(corpus)
    up, down = (target + 1.0) * float(corpus.sum() + b), (corpus + 1.0) * float(target.sum() + b)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise times 1000, floored, from 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("bigint") + 0.5) / 4294967296.0))).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS,
          seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of every document."""
    table = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets))
    id_type = docs.schema[id_col].dataType.simpleString()

    def mean(batches):
        values = pa.array(table)
        for b in batches:
            for part in slices(b, 1):
                bucket, owner, words = features(part.column(1), n, buckets)
                order = np.argsort(owner, kind="stable")
                own = np.bincount(owner, minlength=part.num_rows)
                gain = values.take(pa.array(bucket[order])).to_numpy()
                some = np.flatnonzero(own)
                weight = np.zeros(part.num_rows, np.int64)
                if len(some):
                    starts = np.concatenate([[0], np.cumsum(own[some])[:-1]])
                    weight[some] = np.add.reduceat(gain, starts) // own[some]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(own.astype(np.int64)),
                                                  pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.mapInArrow(mean, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")
    return d.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def _expanded(counted: DataFrame) -> DataFrame:
    """A row per copy, numbered from 0; what has many copies is dealt out in runs before it is expanded."""
    first = F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)")).alias("first")
    many = counted.filter(F.col("copies") > RUN).select("*", first).repartition("id", "score", "first")
    runs = counted.filter(F.col("copies") <= RUN).select("*", F.lit(0).cast("bigint").alias("first")).unionByName(many)
    return runs.select("*", F.explode(F.expr(f"sequence(first, least(first + {RUN}, copies) - 1)")).alias("copy"))


def draw(weighed: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of :func:`weigh` with their rank: 1 for the highest score, null if not drawn."""
    cols = ["id", "n_words", "n_features", "weight", "score"]
    counted = written(weighed.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")), "weighed")
    able = F.col("n_words") >= min_words
    hist = counted.filter(able).groupBy("score").agg(F.sum("copies").alias("c")).collect()  # bounded by the range of scores
    size = percent * sum(r["c"] for r in hist) // 100
    first, before = [], 0
    for r in sorted(hist, key=lambda r: -r["score"]):
        if before >= size:
            break
        first.append((r["score"], before))
        before += r["c"]
    lowest = first[-1][0] if first else None
    in_draw = able & (F.col("score") >= lowest) if first else F.lit(False)
    offsets = counted.sparkSession.createDataFrame(first, "at bigint, offset bigint")
    earlier = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_words", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    drawn = counted.filter(in_draw).select("*", F.coalesce(F.sum("copies").over(earlier), F.lit(0)).alias("nth"))
    drawn = _expanded(drawn.join(F.broadcast(offsets), F.col("score") == F.col("at")))
    rank = F.col("offset") + F.col("nth") + F.col("copy") + 1
    rest = _expanded(counted.filter(~in_draw)).select(*cols, F.lit(None).cast("bigint").alias("rank"))
    return drawn.select(*cols, F.when(rank <= size, rank).alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``id_col``, n_features, weight, score and rank of every document."""
    found = draw(weigh(docs, target, id_col=id_col, text_col=text_col, n=n, buckets=buckets, seed=seed), percent=percent, min_words=min_words)
    return found.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_resample(spark, sf_dir):
    """All ``documents`` towards all ``benchmark`` texts, a tenth of those with 20 words or more."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH words AS (SELECT 0 AS side, row_number() OVER () AS k, doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS (SELECT side, k, unnest(w) AS word FROM words),
counts AS MATERIALIZED (SELECT side, word, count(*) AS c FROM uses GROUP BY side, word),
step0 AS (SELECT b, b AS v FROM range(256) r(b)),
{", ".join(f"step{i} AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM step{i - 1})" for i in range(1, 9))},
crc_table AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM step8),
spelled AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counts)),
buckets AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))),
        lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) % {BUCKETS} AS bucket FROM spelled, crc_table),
sides AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t
    FROM counts JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS cs, coalesce(sum(t), 0) AS ct FROM sides),
gain AS (SELECT word, CAST(floor(1000 * ln(CAST((t + 1) * (cs + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (ct + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
    FROM buckets JOIN sides USING (bucket) CROSS JOIN totals),
weights AS (SELECT k, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM uses JOIN gain USING (word) WHERE side = 0 GROUP BY k),
scored AS (SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(x.w, 0) AS weight,
    coalesce(x.w, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.id AS VARCHAR), '')), 1, 8)) AS BIGINT)
        + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM words d LEFT JOIN weights x ON x.k = d.k WHERE d.side = 0),
ranked AS (SELECT *, n_features >= {MIN_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS}
    ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
