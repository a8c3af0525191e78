"""Operators 11, 12 and 13 against plain versions and on odd input."""
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moldwatch.llm import hashing, resampling, whitening
from moldwatch.llm.queries import QUERIES
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import helpers

NAN, INF = float("nan"), float("inf")
WIDE = "vec_id bigint, embedding array<double>, id string, vec string, label string, shard int, block int, print int, score string, n int, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 9) for i, v in rows], WIDE)


@pytest.fixture(scope="module")
def odd_vectors():
    """Copies, repeats, nulls, zeros, non-finite components, another width, tiny and huge magnitudes, repeated and null ids."""
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.normal(size=6)))) for i in range(60)]
    same = rows[0][1]
    rows += [(100 + i, same) for i in range(12)] + [(50, same), (50, same), (50, [2.0 * x for x in rows[1][1]])]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [NAN] * 6), (205, [INF] + same[1:]),
             (206, [1.0, 2.0]), (None, same), (None, None), (250, [1e-200 * x for x in rows[2][1]]), (300, [1e200 * x for x in rows[3][1]])]
    return rows


# --- neighbours

def nearest(rows, every, k, width):
    """Per (query id, vector) the k nearest (score, id), comparing all."""
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == width and any(v)
                   and all(x is not None and math.isfinite(x) for x in v)})
    u = {v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for _, v in fine}
    return {(i, v): sorted((-float(u[v] @ u[w]), j) for j, w in fine if j != i)[:k] for i, v in fine if i % every == 0}


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    for m in (1, 3, 8):
        codes = rng.integers(0, 256, (300, m), dtype=np.uint8)
        codes[50:100] = codes[0] ^ (rng.random((50, m, 8)) < 0.1).dot(1 << np.arange(8)).astype(np.uint8)
        index = hashing.Index(codes)
        for radius in range(8 * m + 1):
            for q in (codes[0], codes[7], rng.integers(0, 256, m, dtype=np.uint8)):
                gap = np.bitwise_count(codes ^ q).sum(axis=1, dtype=int)
                assert index.within(q, radius).tolist() == np.flatnonzero(gap <= radius).tolist()
    near = [j for j in range(8) if len(index.probe(j, 3, 1))]
    assert len(hashing.masks(1)) == 9 and len(near) == 8 and not len(hashing.masks(-1))


def test_neighbours_of_odd_vectors_are_exact_where_all_bits_are_searched(spark, odd_vectors):
    want = nearest(odd_vectors, 50, 5, 6)
    got = {}
    for r in hashing.nearest_neighbours(table(spark, odd_vectors), recall=1.0, bits=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in want} == {0, 50, 100, 250, 300}
    for i in (0, 100, 250, 300):
        own = sorted(got[i])
        assert [x[0] for x in own] == [1, 2, 3, 4, 5]
        (exact,) = [w for (j, _), w in want.items() if j == i]
        assert [x[2] for x in own] == pytest.approx([-s for s, _ in exact], abs=1e-12)
        assert len({x[1] for x in own}) == 5
    assert [x[1] for x in sorted(got[0])] == [50, 100, 101, 102, 103]      # ties by id
    assert [x[1] for x in sorted(got[100])] == [0, 50, 101, 102, 103]
    assert len(got[50]) == 15                                             # three vectors, three result lists


def test_fewer_rows_than_asked_for(spark, monkeypatch):
    few = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [-1.0, 0.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hashing.nearest_neighbours(table(spark, few)).collect()}
    assert got == {(0, 1): (50, 0.0), (0, 2): (7, -1.0), (50, 1): (0, 0.0), (50, 2): (7, 0.0)}
    assert hashing.nearest_neighbours(table(spark, [])).count() == 0
    assert hashing.nearest_neighbours(table(spark, [(0, [0.0, 0.0]), (1, None)])).count() == 0
    monkeypatch.setattr(hashing, "fit_model", lambda *a, **k: hashing.Model(np.zeros(2), np.eye(2), 0, 8))
    again = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hashing.nearest_neighbours(table(spark, few)).collect()}
    assert again == got  # nothing within radius 0: searched again within all bits


def test_neighbours_blocks_and_shards_change_nothing(spark, odd_vectors, monkeypatch):
    def result():
        return sorted(tuple(r) for r in hashing.nearest_neighbours(table(spark, odd_vectors), every=5, recall=1.0, bits=64).collect())
    whole = result()
    for name, value in (("BLOCK", 5), ("LEAST_SHARD", 10), ("CHUNK", 7)):
        monkeypatch.setattr(hashing, name, value)
    assert result() == whole


def test_recall(spark):
    for sf in (SF_SMALL, SF_MID):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = {i: {j for _, j in w} for (i, _), w in nearest(rows, 50, 5, 64).items()}
        got = {}
        for r in QUERIES["op11_neighbours"](spark, sf).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
        assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * 5 * len(want)


# --- resampling

def grams(text, n):
    w = helpers.words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(docs, target, percent=10, min_words=20, n=1, buckets=10_000, seed=2024):
    """(id, n_features, weight, score, rank) of every (id, text)."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(x, n)[0]) for side in ([x for _, x in docs], target))
    cs, ct = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        g, words = grams(text, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (cs + buckets) / ((s[b] + 1) * (ct + buckets)))) for b in map(bucket, g)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_odd_texts(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 300)
    monkeypatch.setattr(resampling, "RUN", 2)
    target = spark.createDataFrame([("stone harbour and grey birds",), (None,), ("Der Fluss",)], "text string")
    docs, texts = [(i, x) for i, x, _ in odd_rows], [r[0] for r in target.collect()]
    for n, percent, buckets, words in ((1, 10, 10_000, 20), (2, 50, 97, 1), (3, 100, 10_000, 0)):
        got = resampling.resample(odd_docs, target, n=n, percent=percent, buckets=buckets, min_words=words)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == resampled(docs, texts, percent, words, n, buckets)
    assert resampling.resample(no_docs, target).count() == 0
    nothing = target.limit(0)
    assert Counter(map(tuple, resampling.resample(odd_docs, nothing).collect())) == resampled(docs, [])


def test_resampling_ranks_copies_as_one(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 50)
    docs = [(None, "a b c")] * 230 + [(4, "a b c")] * 120 + [(i, f"w{i} b") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    got = resampling.resample(frame, target, min_words=2, percent=80)
    assert Counter(map(tuple, got.collect())) == resampled(docs, ["a b"], 80, 2)


def test_resampling_whole_tables(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    assert Counter(map(tuple, QUERIES["op12_resample"](spark, SF_SMALL).collect())) == resampled(docs, target)


# --- whitening

def plain_whitening(vectors, scale=256, shift=0):
    """x, distinct x, eigenvalues and eigenvectors by a symmetric solver."""
    x = np.array([[math.floor(scale * c) + shift for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    values, unit = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, fit, values[::-1], unit[:, ::-1]


def check_whitening(rows, vectors, ids, k=4, **kw):
    x, fit, values, unit = plain_whitening(vectors, **kw)
    n, sums = len(fit), fit.sum(axis=0)
    z = (x - sums / n) @ unit[:, :k] / np.sqrt(values[:k])
    got = {}
    for r in rows:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        got.setdefault(r["component"], Counter())[r["vec_id"], r["deviation"], round(abs(r["whitened"]), 8) + 0.0] += 1
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    assert set(got) == set(range(1, k + 1))
    for c in got:
        want = Counter((i, d, round(abs(w), 8) + 0.0) for i, d, w in zip(ids, deviation, z[:, c - 1]))
        assert got[c] == want


def test_jacobi_and_cholesky():
    rng = np.random.default_rng(7)
    for d, rank in ((1, 1), (2, 2), (7, 7), (8, 3), (20, 19)):
        g = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, rank)
        a = g @ g.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], rtol=1e-9, atol=1e-12 * np.trace(a))
        turned = whitening.jacobi_columns(factor)
        cross = turned.T @ turned
        size = np.sqrt(np.outer(np.diag(cross), np.diag(cross)))
        assert np.abs((cross - np.diag(np.diag(cross))) / size).max() < 1e-13
        values, unit = whitening.components(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-12 * values[0])
        assert np.allclose((unit * values) @ unit.T, a, atol=1e-12 * np.trace(a))
    assert whitening.components(np.zeros((3, 3)))[0].size == 0


def test_integers_and_packing():
    v = np.array([[0.0, -0.001, 0.999, 1.0], [1e30, -1e30, 2.0 ** 54, -2.0 ** 54], [100.0, 200.0, -1e5, 1e9]])
    x = whitening.integers(v, 256, 0)
    assert x.tolist() == [[0, -1, 255, 256], [2 ** 63 - 1, -2 ** 63, 2 ** 62, -2 ** 62], [25600, 51200, -25600000, 256 * 10 ** 9]]
    assert whitening.integers(v[:1], 256, 3).tolist() == [[3, 2, 258, 259]]
    import pyarrow as pa
    rows = whitening.packed(x)
    assert [len(r) for r in rows] == [8, 32, 32] and sorted(whitening.unpacked(pa.array(rows), 4).tolist()) == sorted(x.tolist())


def test_whitening_odd_vectors(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    moderate = [(i, v) for i, v in odd_vectors if i not in (250, 300)]
    fine = [(i, v) for i, v in moderate if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    assert any(i is None for i, _ in fine)
    got = whitening.whiten(table(spark, moderate)).collect()
    assert len(got) == 4 * len(fine)
    check_whitening(got, [v for _, v in fine], [i for i, _ in fine])
    got = whitening.whiten(table(spark, moderate), k=2, scale=10, shift=5).collect()
    check_whitening(got, [v for _, v in fine], [i for i, _ in fine], k=2, scale=10, shift=5)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    flat = whitening.whiten(table(spark, [(i, [float(i), 7.0, 2.0 * i]) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)
    large = whitening.whiten(table(spark, [(i, [3e12 * i, float(i * i)]) for i in range(4)])).collect()
    assert {r["deviation"] for r in large} == {None}


def test_whitening_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = QUERIES["op13_whitening"](spark, SF_SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(got.collect(), [r[1] for r in rows], [r[0] for r in rows])
    assert got.select(F.countDistinct("identity_error")).first()[0] == 1
