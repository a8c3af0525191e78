"""Operator 13: whitening of embeddings.

A component c becomes the integer floor(scale * c) + shift, and the model is fitted to each
distinct integer vector once, however many rows repeat it.  Their count and sums are exact.
The centred scatter is summed by Spark; on its d x d matrix (d: the vectors' width, which is all
that reaches the driver) a pivoted Cholesky factorisation stops at the numerical rank, and a
one-sided Jacobi method rotates the columns of the triangular factor until they are
orthogonal: their squared norms are the eigenvalues of the covariance, the columns divided by
their norms its eigenvectors.  The covariance itself is never diagonalised.

Distinct vectors are found by a grouping with partial aggregation, so that a vector that a third of all
rows share is one row of each task; the vectors travel as integers of the fewest bytes that
hold them.  The fit list is written to the shared folder and read by the three later passes.

Defined results: rows with a null, empty or non-finite vector, or one of another width than
most, are left out; null and repeated ids and repeated rows are whitened each; components of
zero variance (a constant dimension, a single vector) have no whitened value and no row;
integers beyond 64 bits are the nearest ones within; a deviation beyond 64 bits is null; an
empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.store import written
from moldwatch.llm.vectors import finite_rows, matrix

SCALE = 256
SHIFT = 0
COMPONENTS = 4
ROWS = 4096  # worked on at a time
BYTES = (1, 2, 4, 8)
OUT = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def integers(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift, held within 64 bits."""
    with np.errstate(over="ignore"):
        f = np.floor(scale * v)
    inside = np.clip(f, -2.0 ** 62, 2.0 ** 62).astype(np.int64)
    if (np.abs(f) < 2.0 ** 62).all() and abs(shift) < 2 ** 62:
        return inside + shift
    whole = [max(-2 ** 63, min(2 ** 63 - 1, (int(x) if np.isfinite(x) else (2 ** 64 if x > 0 else -2 ** 64)) + shift)) for x in f.ravel()]
    return np.array(whole, np.int64).reshape(f.shape)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers of the fewest bytes that hold it (equal rows: equal bytes)."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for size in BYTES:
        top = 1 << (8 * size - 1)
        fits = left & (low >= -top) & (high <= top - 1)
        for i, row in zip(np.flatnonzero(fits), x[fits].astype(f"<i{size}")):
            out[i] = row.tobytes()
        left &= ~fits
    return out


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The rows of :func:`packed`, in any order."""
    own = column.to_pylist()
    parts = [np.zeros((0, width), np.int64)]
    for size in BYTES:
        some = b"".join(b for b in own if len(b) == size * width)
        parts.append(np.frombuffer(some, f"<i{size}").astype(np.int64).reshape(-1, width))
    return np.concatenate(parts)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L @ L.T; L has as many columns as ``a`` has numerical rank."""
    d = len(a)
    rest, order, factor = np.diag(a).astype(float).copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[order[k:]]))
        if rest[order[p]] <= least:
            return factor[:, :k], order
        order[[k, p]], factor[[k, p], :k] = order[[p, k]], factor[[p, k], :k]
        i, below = order[k], order[k + 1:]
        factor[k, k] = np.sqrt(rest[i])
        factor[k + 1:, k] = (a[below, i] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        rest[below] -= factor[k + 1:, k] ** 2
    return factor, order


def jacobi_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``g`` times rotations that make its columns orthogonal.  A step of a sweep rotates all
    pairs of a round-robin schedule at once; pairs already orthogonal to working precision stay."""
    g, r = g.copy(), g.shape[1]
    ring = list(range(r + r % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1]) if max(a, b) < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = map(list, zip(*pairs))
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, off.max())
            turn = off > 1e-16
            tau = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, t * c, 0.0)
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if worst < 1e-14:
            break
    return g


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that differ from zero, falling, and their unit eigenvectors as columns (largest entry positive)."""
    factor, order = pivoted_cholesky(covariance)
    rotated = np.zeros_like(factor)
    rotated[order] = jacobi_columns(factor)
    norms = np.sqrt((rotated ** 2).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    falling = falling[norms[falling] > 0]
    unit = rotated[:, falling] / norms[falling]
    for k in range(unit.shape[1]):
        unit[:, k] *= 1 if unit[np.argmax(np.abs(unit[:, k])), k] > 0 else -1
    return norms[falling] ** 2, unit


@dataclass
class Model:
    n: int
    sums: list[int]         # exact
    unit: np.ndarray        # d x k
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.unit / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        top = max(map(abs, self.sums), default=0) + self.n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))))
        if top >= 1 << 45:
            whole = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        else:
            y = self.n * x - np.array(self.sums, np.int64)
            high, low = y >> 23, y & ((1 << 23) - 1)
            hh, hl, ll = ((a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low)))
            whole = [(a << 46) + (b << 24) + c for a, b, c in zip(hh, hl, ll)]
        return [w if w < 1 << 63 else None for w in whole]


def _pieces(batches, width):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield unpacked(b.column(0).slice(at, ROWS), width)


def _products(fit: DataFrame, width: int, project) -> np.ndarray:
    """Sum of z z^T over the fit list, z = project(x), a matrix that every task adds up for itself."""
    def add(batches):
        total = None
        for x in _pieces(batches, width):
            z = project(x)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    cells = fit.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = max((r["j"] for r in cells), default=-1) + 1
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def fit_model(fit: DataFrame, width: int, k: int = COMPONENTS) -> Model | None:
    """The model of a list of distinct packed vectors; None if it is empty."""
    def add(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _pieces(batches, width):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n, np.int64)),
                                          pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(fit.mapInArrow(add, "dim int, n bigint, high bigint, low bigint").groupBy("dim").agg(*total).collect())
    if not rows or not rows[0]["n"]:
        return None
    n, sums = int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    mean = np.array([s / n for s in sums])
    covariance = _products(fit, width, lambda x: x - mean) / n
    values, unit = components(covariance)
    trace = float(np.trace(covariance))
    model = Model(n, sums, unit[:, :k], values[:k], values[:k] / trace if trace else values[:k], 0.0)
    if len(model.eigenvalues):
        again = _products(fit, width, model.whiten) / n
        model.identity_error = float(np.abs(again - np.eye(len(again))).max())
    return model


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT,
           k: int = COMPONENTS) -> DataFrame:
    """``id_col`` and one row per component: component, n, deviation, whitened, explained, identity_error."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows, width = finite_rows(df, id_col, vector_col)

    def code(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = integers(matrix(b.column(0).slice(at, ROWS), width), scale, shift)
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], ["x"])

    fit = written(rows.select("vec").mapInArrow(code, "x binary").distinct(), "fit") if width else None
    model = fit_model(fit, width, k) if width else None
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], f"id {id_type}, {OUT}").withColumnRenamed("id", id_col)

    def project(batches):
        own = len(model.eigenvalues)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = integers(matrix(part.column(1), width), scale, shift)
                each, every = np.repeat(np.arange(len(x)), own), np.tile(np.arange(own), len(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array((every + 1).astype(np.int32)), pa.array(np.full(len(each), model.n)),
                     pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whiten(x).ravel()),
                     pa.array(model.explained[every]), pa.array(np.full(len(each), model.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"id {id_type}, {OUT}").withColumnRenamed("id", id_col)


def op13_whitening(spark, sf_dir):
    """All ``embeddings``, four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
