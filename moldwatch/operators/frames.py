"""Statistics over sliding frames in time linear-logarithmic in the rows.

Spark re-aggregates a sliding frame from its buffered rows for every row, so its
cost is rows x frame rows, and running sums (which would be linear) lose the
variance of values far from zero.  Here each chunk of a series (see ``chunking``)
is one Arrow group: the aggregates (count, mean, sum of squared deviations, min,
max) of all runs of 1, 2, 4 ... rows are built one from the other, and a frame is
put together from the runs in the binary form of its length.  Aggregates
are merged pairwise by the parallel variance formula, so nothing cancels and
a constant frame has a variance of exactly 0.

Chunks bound every group; the work per row grows with the logarithm of the frame.  A group's
results, many columns wide, are made and given out a slice of rows at a time, so only its input is
held whole; the runs of a slice are those of the rows that its frames reach, one value at a time.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_ROWS = 20_000  # rows of a group that are given out at a time, at least; half of the longest frame, if that is more
STAT_COLUMNS = ("n", "mean", "std", "min", "max", "last")


@dataclass(frozen=True)
class Frame:
    """Rows of a frame ending at the current row: the last ``rows`` rows, or those
    less than ``us`` microseconds back (``closed``: or just as many).  With both, the
    time frame where it holds at most ``rows`` rows, else the row frame.  A time frame
    holds all rows of the current time; with ``to_own`` it ends at the current row."""

    name: str
    us: int | None = None
    rows: int | None = None
    closed: bool = False
    to_own: bool = False


def bounds(t: np.ndarray, frame: Frame, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First row and end (exclusive) of every row's frame, or those of the rows ``at``; ``t`` ascending."""
    at = np.arange(len(t)) if at is None else at
    if frame.us is None:
        return np.maximum(at - frame.rows + 1, 0), at + 1
    lo = np.searchsorted(t, t[at] - frame.us, "left" if frame.closed else "right")
    hi = at + 1 if frame.to_own else np.searchsorted(t, t[at], "right")
    if frame.rows is not None:
        over = hi - lo > frame.rows
        lo, hi = np.where(over, at - frame.rows + 1, lo), np.where(over, at + 1, hi)
    return lo, hi


def _merged(a, b):
    n = a[0] + b[0]
    d = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + d * share))
    spread = a[2] + b[2] + np.where((a[0] == 0) | (b[0] == 0), 0.0, d * d * a[0] * share)
    return [n, mean, spread, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])]


def frame_stats(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """n, mean, sum of squared deviations, min and max of the values of ``x`` (rows, columns; NaN
    is no value) in each frame [lo, hi).  Without values: n 0, the others undefined."""
    there = ~np.isnan(x)
    runs = [there.astype(np.float64), np.where(there, x, 0.0), np.zeros(x.shape),
            np.where(there, x, np.inf), np.where(there, x, -np.inf)]
    shape = (len(lo), x.shape[1])
    found = [np.zeros(shape), np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)]
    at, left, size = lo.copy(), hi - lo, 1
    while left.any():
        own = np.flatnonzero(left & size)
        if len(own):
            part = _merged([f[own] for f in found], [r[at[own]] for r in runs])
            for f, p in zip(found, part):
                f[own] = p
            at[own] += size
            left[own] -= size
        if left.any():
            runs = _merged([r[:-size] for r in runs], [r[size:] for r in runs])
            size *= 2
    return found


def slopes(y: np.ndarray, rows: int) -> np.ndarray:
    """Least-squares slope of the values in the last ``rows`` rows against 0, 1, 2 ... (NaN is
    no value and no step); NaN for fewer than two values.  Column by column."""
    n = len(y)
    padded = np.concatenate([np.full((rows - 1, y.shape[1]), np.nan), y])
    there = ~np.isnan(padded)
    step = np.cumsum(there, axis=0).astype(np.float64)
    part = [slice(j, j + n) for j in range(rows)]
    count = sum(there[p] for p in part).astype(np.float64)
    safe = np.maximum(count, 1)
    mk = sum(np.where(there[p], step[p], 0.0) for p in part) / safe
    my = sum(np.where(there[p], padded[p], 0.0) for p in part) / safe
    dk = [np.where(there[p], step[p] - mk, 0.0) for p in part]
    up = sum(k * np.where(there[p], padded[p] - my, 0.0) for k, p in zip(dk, part))
    down = sum(k * k for k in dk)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count >= 2, up / down, np.nan)


def framed(x: DataFrame, part, order: str, values, frames: list[Frame], keep, slope_rows: int | None = None,
           tie: str | None = None) -> DataFrame:
    """The own rows (``_own``) of every group of ``part``: the columns ``keep`` and, for every
    value and frame, ``{value}__{stat}_{frame}`` for the STAT_COLUMNS, n counting the
    values and last being the newest value in the frame, and frame_rows_{frame}; with ``slope_rows``
    also ``{value}__slope``.  ``order``: an integer column (microseconds or row numbers);
    ``tie``: another one, for rows equal in it."""
    values, keep = list(values), list(keep)
    fields = [x.schema[c] for c in keep]
    fields += [T.StructField(f"frame_rows_{f.name}", T.LongType()) for f in frames]
    fields += [T.StructField(f"{v}__{s}_{f.name}", T.LongType() if s == "n" else T.DoubleType())
               for f in frames for v in values for s in STAT_COLUMNS]
    if slope_rows:
        fields += [T.StructField(f"{v}__slope", T.DoubleType()) for v in values]

    def nullable(a, ok):
        return pa.array(np.where(ok, a, 0.0), pa.float64(), mask=~ok)

    def stats_of(t, v, own):
        """Columns of the rows ``own``: rows in each frame, then the statistics of each frame and value."""
        stats, counts = [], []
        for f in frames:
            lo, hi = bounds(t, f, own)
            counts.append(pa.array(hi - lo))
            first, end = lo.min(), hi.max()
            for c in range(len(values)):
                x = v[c][first:end]
                newest = first + np.maximum.accumulate(np.where(np.isnan(x), -1 - first, np.arange(len(x))))  # -1: none
                n, mean, spread, least, most = (a[:, 0] for a in frame_stats(x[:, None], lo - first, hi - first))
                at, some = newest[hi - 1 - first], n > 0
                std = np.sqrt(spread / np.maximum(n - 1, 1))
                stats += [pa.array(n.astype(np.int64)), nullable(mean, some), nullable(std, n > 1), nullable(least, some),
                          nullable(most, some), nullable(v[c][np.maximum(at, 0)], some & (at >= lo))]
        return counts + stats

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        t = table[order].to_numpy()
        by = np.argsort(t, kind="stable") if tie is None else np.lexsort((table[tie].to_numpy(), t))
        t = t[by]
        own = np.flatnonzero(table["_own"].to_numpy(zero_copy_only=False)[by])
        v = [table[c].to_numpy().astype(np.float64)[by] for c in values]
        kept = table.select(list(dict.fromkeys(keep)))
        del table
        reach = max((int((hi - lo).max()) for f in frames for lo, hi in [bounds(t, f, own)]), default=0) if len(own) else 0
        size = max(SLICE_ROWS, reach // 2)
        for i in range(0, len(own), size):
            at = own[i:i + size]
            rows = kept.take(pa.array(by[at]))
            out = [rows[c].combine_chunks() for c in keep] + stats_of(t, v, at)
            if slope_rows:
                first = max(at[0] - slope_rows + 1, 0)
                s = slopes(np.column_stack([x[first:at[-1] + 1] for x in v]), slope_rows)[at - first]
                out += [nullable(s[:, c], ~np.isnan(s[:, c])) for c in range(len(values))]
            made = pa.Table.from_arrays(out, names=[f.name for f in fields]).combine_chunks()
            del out
            yield from made.to_batches(max_chunksize=SLICE_ROWS)

    used = dict.fromkeys([*part, order, *([tie] if tie else []), "_own", *keep, *values])
    x = x.select(*used)
    return x.groupBy(*part).applyInArrow(fn, T.StructType(fields))
