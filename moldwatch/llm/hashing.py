"""Operator 11: nearest neighbours by multi-index hashing.

Codes: vectors are scaled to length 1 and centred, and each bit is the sign of one coordinate after a learned
rotation (iterative quantisation: rotation and signs are fitted to each other in turn);
several rotations with different starts give as many bits as asked for.  Code, centre,
rotations and search radius are learned from a bounded sample, the SAMPLE rows with the
smallest digests: the radius is the least within which the codes of a share RECALL of the sample's
true neighbours lie.

Index: every row is indexed.  Rows are dealt to shards by a digest of id and vector, so no key is hot; a
shard's task splits the codes of CHUNK rows at a time into substrings of SUB_BITS bits and keeps for every
value of every substring a bitmap of the rows that hold it.

Search: the queries, in blocks, meet every shard.  If two codes differ in at most R = m * a + b
bits (m substrings, b < m), they differ by at most a bits in one of the first b + 1
substrings or by at most a - 1 in one of the others.  Probing unites the bitmaps of all values
that near, which finds every code within R; whole codes are compared next, and the vectors of
what remains in double precision.  A task sends each query's best k rows and one more.
Queries that have found fewer than k rows within R search again within all bits, which is
the exact search; so nothing is capped.

Equal (id, vector) rows are one row before anything is dealt, and rows of equal vectors are compared
once in a chunk.  Neither pairs nor candidates are rows of a table: only results are shuffled.

Defined results: rows without id and vectors that are null, empty, zero, of another width than
most or hold null or non-finite components take no part; a row repeated whole counts once;
all rows of a query's own id are left out for it; an id with several vectors is several
queries, each with ranks from 1; ties go to the smaller id; an empty table gives no rows;
other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.llm.store import written
from moldwatch.llm.vectors import finite_rows, matrix

K = 5
EVERY = 50
BITS = 256
SUB_BITS = 8
RECALL = 0.99
SAMPLE = 20_000       # rows that reach the driver to learn from
FIT_ROWS = 4_000      # of them, for the rotations
PROBES = 400          # of them, for the radius
ITERATIONS = 20
SEED = 11
CHUNK = 8_192         # rows under one set of bitmaps
LEAST_SHARD, MOST_SHARD, SHARDS = 4_096, 131_072, 64
BLOCK = 16_384        # queries that one task holds


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def tamed(v: np.ndarray) -> np.ndarray:
    """Rows of extreme magnitude times a power of two, which no cosine sees, so that squares neither overflow nor vanish."""
    top = np.abs(v).max(axis=1, initial=0.0)
    far = np.flatnonzero((top < 1e-100) | (top > 1e100))
    if len(far):
        v = v.copy()
        v[far] = np.ldexp(v[far], -np.frexp(top[far])[1][:, None])
    return v


@dataclass
class Model:
    centre: np.ndarray
    turn: np.ndarray      # d x bits
    radius: int
    bits: int

    def codes(self, u: np.ndarray) -> np.ndarray:
        """Rows of bits / 8 bytes."""
        return np.packbits((u - self.centre) @ self.turn > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ (rows of ``a`` against ``b``, broadcast)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def fit_model(v: np.ndarray, *, k: int = K, bits: int = BITS, recall: float = RECALL, seed: int = SEED) -> Model:
    """Centre, rotations and radius from a sample of vectors."""
    rng = np.random.default_rng(seed)
    u = unit(v)
    part, d = u[:FIT_ROWS], u.shape[1]
    centre = part.mean(axis=0)
    turns = []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            signs = np.where((part - centre) @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd((part - centre).T @ signs)
            turn = left @ right
        turns.append(turn)
    model = Model(centre, np.hstack(turns)[:, :bits], bits, bits)
    codes, gaps = model.codes(u), []
    for i in range(min(PROBES, len(u))):
        nearness = u @ u[i]
        nearness[i] = -np.inf
        near = np.argsort(-nearness, kind="stable")[:min(k, len(u) - 1)]
        gaps.append(distances(codes[near], codes[i]))
    gaps = np.sort(np.concatenate(gaps)) if gaps else np.zeros(0)
    if len(gaps):
        model.radius = int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)])
    return model


def masks(most: int) -> np.ndarray:
    """All bytes of at most so many bits (none if negative)."""
    every = np.arange(1 << SUB_BITS)
    return every[np.bitwise_count(every.astype(np.uint8)) <= most]


class Index:
    """Codes of some rows, split into substrings, with a bitmap for each value of each substring."""

    def __init__(self, codes: np.ndarray):
        n, self.m = codes.shape
        self.wide = np.ascontiguousarray(codes).view(np.uint64 if self.m % 8 == 0 else np.uint8)  # for whole comparisons
        bits = np.zeros((self.m, 1 << SUB_BITS, n), bool)
        for j in range(self.m):
            bits[j, codes[:, j], np.arange(n)] = True
        self.rows = np.packbits(bits, axis=2)
        self.united: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, value: int, most: int) -> np.ndarray:
        """Rows whose substring j differs from ``value`` in at most ``most`` bits, as a bitmap."""
        key = (j, value, most)
        if key not in self.united:
            self.united[key] = np.bitwise_or.reduce(self.rows[j, value ^ masks(most)], axis=0)
        return self.united[key]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all rows whose code differs in at most ``radius`` bits."""
        a, b = divmod(radius, self.m)
        found = np.zeros(self.rows.shape[2], np.uint8)
        for j in range(self.m):
            most = a if j <= b else a - 1
            if most >= SUB_BITS:
                found[:] = 255
                break
            if most >= 0:
                found |= self.probe(j, int(code[j]), most)
        some = np.flatnonzero(np.unpackbits(found, count=len(self.wide)))
        return some[distances(self.wide[some], np.ascontiguousarray(code).view(self.wide.dtype)) <= radius]


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of equal rows, and every row's place among these."""
    keys = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return first, place


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def search(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, model: Model, radius: int, k: int):
    """(number of the query, ids, scores) of the nearest rows found within the radius, of each query in turn."""
    first, place = _distinct(q)
    q_codes = model.codes(unit(q[first]))
    q_norm = np.sqrt((q[first] ** 2).sum(axis=1))
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(first)
    for at in range(0, len(v), CHUNK):
        own, own_ids = v[at:at + CHUNK], ids[at:at + CHUNK]
        one, group = _distinct(own)
        by_group = np.lexsort((own_ids, group))
        bounds = np.searchsorted(group[by_group], np.arange(len(one) + 1))
        vectors = own[one]
        norm = np.sqrt((vectors ** 2).sum(axis=1))
        index = Index(model.codes(unit(vectors)))
        single = len(one) == len(own)
        for i in range(len(first)):
            some = index.within(q_codes[i], radius)
            if not len(some):
                continue
            score = (vectors[some] * q[first[i]]).sum(axis=1) / (norm[some] * q_norm[i])  # a sum of its own each: ties stay ties
            if single:
                members = own_ids[one[some]]
            else:  # of equal rows the smallest k + 1 ids are enough
                top = np.minimum(bounds[some + 1] - bounds[some], k + 1)
                spread = np.repeat(bounds[some] - np.concatenate([[0], np.cumsum(top)[:-1]]), top) + np.arange(top.sum())
                members, score = own_ids[by_group[spread]], np.repeat(score, top)
            keep = _best(score, members, k + 1)
            both_ids, both = np.concatenate([best[i][0], members[keep]]), np.concatenate([best[i][1], score[keep]])
            keep = _best(both, both_ids, k + 1)
            best[i] = both_ids[keep], both[keep]
    for i in range(len(q)):
        found, score = best[place[i]]
        other = np.flatnonzero(found != query_ids[i])[:k]
        yield i, found[other], score[other]


def _shard(n: int) -> tuple[Column, int]:
    """The shard of a row, and how many there are, for n rows in all."""
    shards = max(-(-n // MOST_SHARD), min(SHARDS, -(-n // LEAST_SHARD)))
    return F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"), shards


def _found(rows: DataFrame, queries: DataFrame, n: int, n_queries: int, model: Model, radius: int, width: int, k: int) -> DataFrame:
    """The nearest rows of each query within the radius: query, print, vec_id, score, rank."""
    shard, shards = _shard(n)
    blocks = max(1, -(-n_queries // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = rows.select("id", "vec", shard.alias("shard"), every(blocks).alias("block"))
    asked = queries.select("id", "print", "vec", F.pmod(F.xxhash64("id", "print"), F.lit(blocks)).cast("int").alias("block"),
                           every(shards).alias("shard"))

    def meet(left, right):
        ids, q_ids, prints = (t.column(c).to_numpy() for t, c in ((left, "id"), (right, "id"), (right, "print")))
        out = []
        if len(ids) and len(q_ids):
            v, q = (tamed(matrix(t.column("vec").combine_chunks(), width)) for t in (left, right))
            out = list(search(ids, v, q_ids, q, model, radius, k))
        count = [len(f) for _, f, _ in out]
        who = np.repeat(np.array([i for i, _, _ in out], np.int64), count)
        return pa.table([pa.array(q_ids[who]), pa.array(prints[who]), pa.array(np.concatenate([f for _, f, _ in out] or [np.zeros(0, np.int64)])),
                         pa.array(np.concatenate([s for _, _, s in out] or [np.zeros(0)]))], ["query_id", "print", "vec_id", "score"])

    pairs = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        meet, "query_id bigint, print bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    # an id may repeat among candidates with several vectors; each is a candidate of its own
    return pairs.select("*", F.row_number().over(nearest).alias("rank")).filter(F.col("rank") <= k)


def nearest_neighbours(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K,
                       bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest rows found of every row whose id is divisible by ``every``."""
    if bits % SUB_BITS:
        raise ValueError(f"bits must be a multiple of {SUB_BITS}")
    spark = df.sparkSession
    rows, width = finite_rows(df, id_col, vector_col)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    some = rows.filter(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0))
    rows = written(some.select(F.col("id").cast("bigint").alias("id"), "vec").distinct(), "vectors") if width else None
    n = rows.count() if width else 0
    if not n:
        return spark.createDataFrame([], out)
    digest = F.xxhash64("vec", "id")
    share = min(1.0, 1.2 * SAMPLE / n)  # digests are uniform: the smallest are among these
    sample = rows.filter(digest <= min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)).orderBy(digest, "id").limit(SAMPLE).select("vec").toArrow()
    model = fit_model(matrix(sample.column("vec").combine_chunks(), width), k=k, bits=bits, recall=recall)
    queries = rows.filter(F.col("id") % every == 0).withColumn("print", F.xxhash64("vec"))
    n_queries = queries.count()
    first = written(_found(rows, queries, n, n_queries, model, model.radius, width, k), "found")
    full = first.groupBy("query_id", "print").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"), "print")
    short = written(queries.join(full, ["id", "print"], "left_anti"), "short")
    n_short = short.count()
    if n_short:
        again = _found(rows, short, n, n_short, model, bits, width, k)
        done = first.join(short.select(F.col("id").alias("query_id"), "print"), ["query_id", "print"], "left_anti")
        first = done.unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_neighbours(spark, sf_dir):
    """All ``embeddings``: the five nearest of every fiftieth."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
