"""Operator 10: toxicity from character n-grams with naive Bayes scaling.

Features are the presence of hashed character n-grams (3 to 5 code points, A-Z lowered).  Over the training
rows each has a log-count ratio r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)) (p, q:
toxic and other documents that hold it, of P and Q); the features that tell the classes
apart best are kept, scaled by their r and weighted by L2-regularised logistic regression.

Fitting takes a bounded, documented sample: of the documents of the ``MAX_TRAIN`` labelled ids with the
smallest digests at most ``MAX_TRAIN``, by digest too, equal texts of an id once; so ids
and text digests are a bounded broadcast.  N-gram counts are aggregated by Spark;
the driver receives N_FEATURES ratios and, per training row, N_FEATURES presence bits
(2.5 MB in all).  All documents are scored whole in one scan without a shuffle.

Defined results: null and empty texts have no features and get the intercept's score; null
labels are ignored; a document labelled twice is toxic if one label says so; without
labels of both classes every score is the share of toxic labels (0 without labels);
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.langid import fold
from moldwatch.llm.shingles import M3, U, mix
from moldwatch.llm.store import written

GRAMS = (3, 4, 5)
HASH_BITS = 20
MAX_TRAIN = 20_000
N_FEATURES = 1024
MIN_DOCS = 4
L2 = 0.2
THRESHOLD = 0.3
CHUNK = 1 << 18  # characters of a text worked on at a time


def grams(text: bytes):
    """Hashes of all n-grams of a text, in arrays."""
    longest = max(GRAMS)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    for at in range(0, max(1, len(points)), CHUNK):
        part = points[at:at + CHUNK + longest - 1].astype(U)
        part[(part >= U(65)) & (part <= U(90))] += U(32)
        values = mix((part + U(1)) * M3)
        h = np.zeros(len(part), U)
        for k in range(longest):
            left = len(part) - k
            if left <= 0:
                break
            h = h[:left] * M3 + values[k:]
            if k + 1 in GRAMS:
                own = left if at + CHUNK >= len(points) else min(left, CHUNK)
                yield (mix(h[:own] + U(k)) >> U(64 - HASH_BITS)).astype(np.int64)


def buckets_of(text: bytes) -> np.ndarray:
    """Numbers of the n-grams that a text holds, each once."""
    found = list(grams(text))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    buckets: np.ndarray   # of the features
    weights: np.ndarray   # log-count ratio times regression weight
    intercept: float

    def table(self) -> np.ndarray:
        place = np.full(1 << HASH_BITS, -1, np.int16)
        place[self.buckets] = np.arange(len(self.buckets))
        return place


def present(text: bytes, place: np.ndarray) -> np.ndarray:
    """Numbers of the features that a text holds."""
    found = [f[f >= 0] for f in (place[g] for g in grams(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int16)


def regress(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps (the last weight is the free intercept)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * len(y) / 100)
    penalty[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_train`` labelled documents."""
    none = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(
        F.max(F.col(label_col).cast("int")).alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(max_train)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))
    own = d.select("id", "print").join(F.broadcast(chosen), F.col("id") == F.col("lid")).groupBy("lid", "y", F.col("print").alias("lprint")).agg(
        F.lit(1).alias("one")).orderBy(F.xxhash64("lid"), "lid", "lprint").limit(max_train)
    own = F.broadcast(own.select("lid", "y", "lprint"))
    rows = d.join(own, (F.col("id") == F.col("lid")) & (F.col("print") == F.col("lprint")))
    sample = written(rows.groupBy("id", "y", "print").agg(F.min("text").alias("text")).repartition(8, "id", "print").drop("print"), "sample")
    totals = dict(sample.groupBy("y").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return none if not n1 else Model(none.buckets, none.weights, np.inf)

    def count(batches):
        docs_with = np.zeros((2, 1 << HASH_BITS), np.int32)
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text")):
                docs_with[y, buckets_of(t.as_py())] += 1
        some = np.flatnonzero(docs_with.any(axis=0))
        for at in range(0, len(some), 100_000):
            own = some[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(docs_with[1, own]), pa.array(docs_with[0, own])], ["bucket", "p", "q"])

    share = (F.col("p") + F.col("q")) / (n1 + n0)
    z = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    ratio = F.log((F.col("p") + 1) / (n1 + 2)) - F.log((F.col("q") + 1) / (n0 + 2))
    best = (sample.select("y", "text").mapInArrow(count, "bucket bigint, p int, q int").groupBy("bucket")
            .agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter(F.col("p") + F.col("q") >= MIN_DOCS)
            .select("bucket", ratio.alias("r"), z.alias("z")).orderBy(F.desc("z"), "bucket").limit(N_FEATURES).collect())
    buckets = np.array([r["bucket"] for r in best], np.int64)
    ratios = np.array([r["r"] for r in best])
    place = Model(buckets, ratios, 0.0).table()

    def mark(batches):
        for b in batches:
            bits = np.zeros((b.num_rows, N_FEATURES), bool)
            for i, t in enumerate(b.column("text")):
                bits[i, present(t.as_py(), place)] = True
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"),
                                              pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["id", "y", "bits"])

    rows = sorted(sample.mapInArrow(mark, "id string, y int, bits binary").collect())  # max_train rows of N_FEATURES / 8 bytes
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :len(buckets)]
    weights, intercept = regress(x.astype(np.float32) * ratios.astype(np.float32), np.array([r["y"] for r in rows], np.float64), L2)
    return Model(buckets, weights * ratios, intercept)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (probability of label 1) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def judge(batches):
        place = model.table()
        for b in batches:
            sums = [model.intercept + model.weights[present(t.as_py() or b"", place)].sum() for t in b.column("text")]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-np.array(sums, np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p, pa.float64())], ["id", "score"])

    return d.mapInArrow(judge, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir):
    """Contract query: all ``documents``, learned from three of four folds of ``labels.toxic``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 4) != 2)
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                    F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
