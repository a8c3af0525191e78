"""Operator 6: near duplicates by BagMinHash.

A document is the multiset of its five-word shingles.  Every shingle stands for
Poisson processes, one for each block of its discretised weight axis ((0, 1], (1, 2],
(2, 4], (4, 8] ...), whose points carry a signature place and a level; a document keeps
the points at levels up to its shingle's count, splitting the block that the count
ends in.  The first point at each place is the signature: two documents agree at a
place with a probability equal to their weighted Jaccard similarity.  Points are
generated in order of time up to the time when all places are filled, so most shingles
cost one draw.

Signatures are banded.  Of each bucket the smallest document leads: all others are verified
against it by exact multiset overlap, and what is left in other classes against the
member with most links so far.  Members that this does not put into one class are
then compared with all members of the bucket's other classes, inside a join that gives the links
alone, unless the elements that a member has alone already rule a link out.  So every pair that shares a bucket is either verified or already in one class, and a
bucket of thousands of copies makes as many rows, not their square.  Classes are the connected components of verified
pairs, found by alternating large-star and small-star steps.

Equal multisets are one node from the start.  Only documents that share a bucket have their
texts read again for the exact overlap.

Defined results: texts without words are alone in their class (class_id is their own id);
fewer than five words are one shingle; repeated rows are in one class, a row each; a null id
has the class of its text (null if nobody else in it has an id); an empty table gives no rows.
Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.shingles import M3, U, mix, shingle_counts, times
from moldwatch.llm.store import written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
CHUNK = 500_000  # bytes of text worked on at a time


def _points(doc, h, block, weight, until, m, sig) -> None:
    """Draws every row's Poisson process up to its document's time ``until`` and lowers the
    signature: the time's 32 float bits, then 32 bits that tell the point.  Rows that are left
    over when few are still running get several draws at once."""
    size = np.where(block > 0, np.exp2(block - 1.0), 1.0)
    key = mix(h + (block.astype(U) + U(1)) * M3)
    time, limit = np.zeros(len(h)), until[doc]
    flat, at, drawn = sig.reshape(-1), np.arange(len(h)), 0
    while len(at):
        draws = np.array([times(drawn + 1 + i) for i in range(min(64, 1 + 8192 // len(at)))], U)
        drawn += len(draws)
        r = mix(key[at][:, None] + draws)
        gaps = -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / size[at][:, None]
        when = np.cumsum(np.hstack([time[at][:, None], gaps]), axis=1)[:, 1:]
        row, nth = np.nonzero(when <= limit[at][:, None])
        time[at] = when[:, -1]
        when, k = when[row, nth], at[row]
        r = mix(key[k] ^ draws[nth] ^ U(1))
        place = (r >> U(32)) % U(m)
        level = np.where(block[k] > 0, size[k] + 1 + np.floor((mix(r + U(7)) >> U(11)).astype(np.float64) * 2.0 ** -53 * size[k]), 1)
        kept = level <= weight[k]
        value = (when[kept].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (r[kept] & U(0xFFFFFFFF))
        np.minimum.at(flat, doc[k[kept]] * m + place[kept].astype(np.int64), value)
        at = at[time[at] <= limit[at]]


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of the multisets given by (document, element, count); the value of a
    document without elements is the largest number everywhere."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n, m), empty)
    total = np.bincount(doc, weights=count, minlength=n)
    deepest = int(count.max()).bit_length() if len(count) else 0
    parts = [(doc, h, np.zeros(len(h), np.int64), count)]
    for b in range(1, deepest + 1):
        more = count > 2 ** (b - 1)
        parts.append((doc[more], h[more], np.full(more.sum(), b), count[more]))
    doc, h, block, count = (np.concatenate(x) for x in zip(*parts))
    factor, todo = math.log(m) + 3, total > 0
    while todo.any():
        rows = todo[doc]
        sig[todo] = empty
        until = np.where(total > 0, m * factor / np.maximum(total, 1), 0.0)
        _points(doc[rows], h[rows], block[rows], count[rows], until, m, sig)
        todo = todo & (sig == empty).any(axis=1)
        factor *= 2
    return sig


def _chunks(column) -> list[list[bytes]]:
    """The texts of an Arrow column in lists of about CHUNK bytes."""
    found, size = [], 0
    for t in column:
        t = t.as_py() or b""
        if found and size + len(t) > CHUNK:
            yield found
            found, size = [], 0
        found.append(t)
        size += len(t)
    if found:
        yield found


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """``docs`` (id, print, text) as (id, print, node, n, bands): node is the digest of the multiset
    (null without words), n its size, bands the hashes of the signature's bands."""
    id_type = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in batches:
            nodes, sizes, keys = [], [], []
            for texts in _chunks(b.column("text")):
                doc, h, count = shingle_counts(texts, words)
                total = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
                at = np.searchsorted(doc, np.arange(len(texts) + 1))
                sig = bag_minhash(doc, h, count, len(texts), bands * rows) & U(0xFFFFFFFF)
                key = np.zeros((len(texts), bands), U)
                for r in range(rows):
                    key = mix(key + sig.reshape(len(texts), bands, rows)[:, :, r] + M3)
                key = mix(key + np.arange(bands, dtype=U) * M3).view(np.int64)
                for d in range(len(texts)):
                    x, y = at[d], at[d + 1]
                    if x == y:
                        nodes.append(None)
                        keys.append(None)
                    else:
                        nodes.append(hashlib.blake2b(h[x:y].tobytes() + count[x:y].astype(np.int64).tobytes(), digest_size=16).digest())
                        keys.append(key[d])
                sizes.extend(total.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("print"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "print", "node", "n", "bands"])

    return docs.select("id", "print", F.col("text").cast("binary").alias("text")).mapInArrow(
        sign, f"id {id_type}, print bigint, node binary, n bigint, bands array<bigint>")


def elements(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``texts`` (text) as (node, elems): the multiset as a set, its k-th copy of a shingle told apart."""

    def expand(batches):
        for b in batches:
            nodes, elems = [], []
            for chunk in _chunks(b.column("text")):
                doc, h, count = shingle_counts(chunk, words)
                at = np.searchsorted(doc, np.arange(len(chunk) + 1))
                for d in range(len(chunk)):
                    own, c = h[at[d]:at[d + 1]], count[at[d]:at[d + 1]]
                    if not len(own):
                        continue
                    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    each = np.repeat(own, c)
                    nodes.append(hashlib.blake2b(own.tobytes() + c.astype(np.int64).tobytes(), digest_size=16).digest())
                    elems.append(np.where(nth == 0, each, mix(each + nth.astype(U) * M3)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(elems, pa.list_(pa.int64()))], ["node", "elems"])

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(expand, "node binary, elems array<bigint>")


def verified(pairs: DataFrame, elems: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets' overlap reaches ``similarity``."""
    one = elems.select(F.col("node").alias("a"), F.col("elems").alias("ea"))
    two = elems.select(F.col("node").alias("b"), F.col("elems").alias("eb"))
    p = pairs.select("a", "b").join(one, "a").join(two, "b").select(
        "a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"), F.size(F.array_intersect("ea", "eb")).alias("both"))
    return p.filter(_overlap(F.col("both"), F.col("na") + F.col("nb"), similarity)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected link table (a, b) that isn't the smallest it is
    connected with; root is that smallest node.  Large-star and small-star steps until
    nothing changes."""
    def stamp(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a > b").distinct(), "edges")  # a > b
    before, now = None, stamp(edges)
    while before != now:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                              F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(
            "e.a", "e.b").filter("a > b").distinct()
        edges = written(edges, "edges")
        before, now = now, stamp(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _overlap(both, sizes, similarity: float):
    """Whether an overlap reaches ``similarity`` given the sum of both sizes."""
    return both >= similarity * (sizes - both) - 1e-9


def _key(text_print, doc_id):
    """Never null: tells documents apart by text and id."""
    return F.concat_ws(":", text_print, doc_id.cast("string"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, n, root) with each node's class so far."""
    return members.select("band", "node", "n").join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))


def _near(n: str, k: str, similarity: float):
    return F.least(n, k) >= similarity * F.greatest(n, k) - 1e-9


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id_col``, print (xxhash64 of its text) and class_id, the
    smallest id of its class."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    f = written(features(d, bands, rows, words), "features")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "print"))
    nodes = written(f.filter("node is not null").groupBy("node").agg(
        first.alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    band_rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    leads = band_rows.groupBy("band").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(band_rows.join(leads.select("band", "lead"), "band"), "members")

    # The texts of all documents in a shared bucket, once per node.
    wanted = members.select("node").distinct().join(nodes, "node").select(_key(F.col("rep.print"), F.col("rep.id")).alias("key"))
    texts = d.select(_key(F.col("print"), F.col("id")).alias("key"), "text").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    elems = written(elements(texts.select("text"), words), "elements")

    stars = members.filter((F.col("node") != F.col("lead.node")) & _near("n", "lead.n", similarity)).select(
        F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    links = written(verified(stars, elems, similarity), "links")
    roots = components(links)

    # Buckets that hold several classes: the member with most links against all of other classes.
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    m = written(_rooted(members, roots).join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "rooted")
    hubs = m.groupBy("band").agg(F.max(F.struct("degree", "node", "n", "root")).alias("hub"), F.min("root").alias("low"),
                                 F.max("root").alias("high")).filter("low < high").select("band", "hub")
    spokes = m.join(hubs, "band").filter((F.col("root") != F.col("hub.root")) & _near("n", "hub.n", similarity)).select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    so_far = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(so_far.unionByName(verified(spokes, elems, similarity)))

    # Buckets that still do: each class but the largest against all others, member by member.
    m = _rooted(members, roots)
    sizes = m.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("classes")).filter(
        "classes > 1").select("band", F.col("most.root").alias("most"))
    m = written(m.join(mixed, "band"), "mixed")
    # What a node shares with no other of these cannot be overlap: the rest bounds it.
    there = written(m.select("node").distinct().join(elems, "node"), "there")
    once = there.select("node", F.explode("elems").alias("e")).groupBy("e").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("c")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    there = there.join(once, "node", "left").select("node", "elems", (F.size("elems") - F.coalesce("own", F.lit(0))).alias("most_shared"))
    there = there.filter(F.col("most_shared") >= similarity * F.size("elems") - 1e-9)  # else no partner of any size
    m = written(m.join(there, "node"), "open")
    few = m.filter("root != most").select("band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"),
                                          F.col("elems").alias("ex"), F.col("most_shared").alias("sx"))
    # Verified inside the join: pairs that are too far apart never become rows.
    more = few.join(m, "band").where(
        (F.col("root") != F.col("rx")) & ((F.col("root") == F.col("most")) | (F.col("x") < F.col("node"))) & _near("n", "nx", similarity)
        & _overlap(F.least("sx", "most_shared"), F.col("nx") + F.col("n"), similarity)
        & _overlap(F.size(F.array_intersect("ex", "elems")), F.col("nx") + F.col("n"), similarity))
    so_far = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = so_far.unionByName(more.select(F.col("x").alias("a"), F.col("node").alias("b")))
    roots = written(components(more), "roots")

    rooted = f.select("id", "print", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return rooted.join(named, "root", "left").select(
        F.col("id").alias(id_col), "print", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("class_id"), "root")


def op6_near_dup(spark, sf_dir):
    """The near-duplicate class of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


# All pairs that share a shingle, without signatures.
OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {WORDS - 1}))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS o FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE o >= CAST({SIMILARITY} AS DOUBLE) * (na.n + nb.n - o) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS class_id FROM d LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
