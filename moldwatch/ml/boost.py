"""Boosted trees from binned rows (ML1, ML6).

A tree learner sees of a row nothing but its bins, its label and its weight.  Every feature is cut once into at most
BINS bins of about equal numbers of rows, all rows counted; a row is then a byte a feature, kept in the memory of one
task for the whole fit.  A tree grows level by level as in Spark ML: the rows' residuals are summed per node,
feature and bin, the sums of all tasks are added up, and every task finds the same cuts from them.  Of two
children only the smaller one is summed, the other is the difference to their parent.  So a level costs one
exchange of sums, whose size depends on the nodes and bins and not on the rows, where a job a level read all rows
again.

Where the bins of all features make few combinations (four sensors), equal rows are counted first: n of them enter a
round's sample Binomial(n, share) times, so the work doesn't grow with the rows.  What is small enough is boosted by one
task; else one task per core holds a part of the rows, all at once (a barrier stage), and they
exchange their sums through a folder that all of them see.  Without such a folder the caller falls back on Spark ML.

Losses, residuals, tree weights, gain, smallest leaf, row share and features per node are Spark ML's.  Samples are
drawn per shard of the rows' digest, so the trees depend on neither the order nor the partitions of the rows.
"""
from __future__ import annotations

import json
import math
import os
import sys
import tempfile
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moldwatch.ml.trees import AUC_BINS, best_prefix
from moldwatch.session import checkpoint_dir, scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

BINS, BITS = 32, 5     # Spark ML's maxBins; two features share a 16-bit code
GROUPS = 512           # a task's summary of one feature
CELLS = 1 << 20        # combinations of bins up to which equal rows are counted
SHARDS = 64
BLOCK = 1 << 18        # positions that are summed at once
ONE_TASK = 1 << 24     # rows x features x models that one task boosts alone
WIDEST = 4096          # features; wider tables are left to Spark ML
SILENCE_S = 900        # a task waits so long for the sums of another
NODES = ("model int, tree int, prediction array<double>, left array<int>, right array<int>, feature array<int>, cut array<int>, "
         "gain array<double>, count array<double>, weight array<double>, total array<double>, squares array<double>, scores array<double>")


@dataclass
class Settings:
    rounds: int
    rate: float
    depth: int
    smallest: int = 1        # rows in a leaf
    share: float = 1.0       # rows of a round
    drawn: int | None = None # features of a node
    logistic: bool = False
    patience: int = 0
    seed: int = 42


class NoCommonFolder(Exception):
    """The tasks can't see each other's files."""


# --- bins --------------------------------------------------------------------

def summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, most, count) of at most about GROUPS runs of the sorted values; equal values stay together, and each has
    a run of its own if there are few."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    if len(starts) > GROUPS:
        starts = starts[np.unique(np.searchsorted(starts, np.arange(GROUPS) * len(x) // GROUPS))[:GROUPS].clip(max=len(starts) - 1)]
        starts = np.unique(np.concatenate([[0], starts]))
    ends = np.concatenate([starts[1:], [len(x)]]) if len(x) else starts
    return x[starts], x[ends - 1], ends - starts


def edges_of(least: np.ndarray, most: np.ndarray, count: np.ndarray) -> list[float]:
    """Upper edges of all bins but the last, midway between the bins' values where these are apart."""
    runs: dict = {}
    for a, b, n in zip(least.tolist(), most.tolist(), count.tolist()):
        low, own = runs.get(b, (a, 0))
        runs[b] = (min(a, low), own + n)
    top = sorted(runs)
    n = np.array([runs[b][1] for b in top], float)
    if len(top) <= BINS:
        at = np.arange(len(top))
    else:
        at = np.floor((np.cumsum(n) - n) * BINS / n.sum())
    edges = []
    for i in np.flatnonzero(np.diff(at) > 0):
        low, high = top[i], min(runs[b][0] for b in top[i + 1:i + 2])
        mid = low / 2 + high / 2
        edges.append(mid if low <= mid < high else low)
    return edges


def columns_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows' array ``_x``, a row per element."""
    return np.ascontiguousarray(batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).T)


def bin_edges(rows: DataFrame, features) -> list[list[float]]:
    """Per feature the edges of its bins, from all rows: tasks send summaries, which one group a feature puts together."""
    names = list(features)
    limit = 1 << 18

    def summed(batches):
        held, n = [], 0

        def out():
            parts = [summary(np.concatenate([h[j] for h in held])) for j in range(len(names))]
            i = np.repeat(np.arange(len(names)), [len(p[0]) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32))] + [
                pa.array(np.concatenate([p[k] for p in parts])) for k in range(3)], ["i", "least", "most", "count"])

        for b in batches:
            held.append(columns_of(b, len(names)))
            n += b.num_rows
            if n >= limit:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merged(t: pa.Table) -> pa.Table:
        own = edges_of(*(t[c].to_numpy() for c in ("least", "most", "count")))
        return pa.table({"i": t["i"].slice(0, 1).combine_chunks(), "edges": pa.array([own], pa.list_(pa.float64()))})

    parts = rows.select(F.array(*[F.col(c).cast("double") for c in names]).alias("_x")).mapInArrow(summed, "i int, least double, most double, count bigint")
    found = {r["i"]: r["edges"] for r in parts.groupBy("i").applyInArrow(merged, "i int, edges array<double>").collect()}  # a row per feature
    return [found.get(j, []) for j in range(len(names))]


def few_cells(edges, targets) -> bool:
    return math.prod(len(e) + 1 for e in edges) <= CELLS and len(targets) == 1


def binned(rows: DataFrame, features, edges, targets, weight: str | None, held: str | None) -> DataFrame:
    """(_held, _y, _w, _bins, _n): a byte a feature; equal rows are counted where the bins make few combinations."""
    names, cuts = list(features), [np.asarray(e, float) for e in edges]

    def coded(batches):
        for b in batches:
            x = np.empty((b.num_rows, len(names)), np.uint8)
            for j, own in enumerate(columns_of(b, len(names))):
                x[:, j] = np.searchsorted(cuts[j], own)
            ends = pa.array(np.arange(0, x.size + 1, len(names)), pa.int32())
            bins = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("_held"), b.column("_y"), b.column("_w"), bins], ["_held", "_y", "_w", "_bins"])

    x = rows.select(F.array(*[F.col(c).cast("double") for c in names]).alias("_x"), (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("_held"),
                    F.array(*[F.col(t).cast("double") for t in targets]).alias("_y"),
                    (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    x = x.mapInArrow(coded, "_held boolean, _y array<double>, _w double, _bins binary")
    if few_cells(edges, targets):
        return x.groupBy("_held", "_y", "_w", "_bins").agg(F.count(F.lit(1)).alias("_n"))
    return x.withColumn("_n", F.lit(1).cast("bigint"))


# --- rows of a task ------------------------------------------------------------

class Rows:
    """Binned rows, two features in a code; ``n`` says how many rows each stands for, if equal rows were counted."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray | None, shard: np.ndarray):
        by = np.argsort(shard, kind="stable")
        self.features = bins.shape[1]
        self.pairs = np.empty(((self.features + 1) // 2, len(by)), np.uint16)
        for q in range(len(self.pairs)):
            high = bins[by, 2 * q].astype(np.uint16)
            self.pairs[q] = high << BITS
            if 2 * q + 1 < self.features:
                self.pairs[q] |= bins[by, 2 * q + 1]
        self.y = y[:, by]
        self.w = None if (w == 1).all() else w[by]
        self.n = None if n is None else n[by]
        shard = shard[by]
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
        self.shards = [(int(shard[a]), int(a), int(b)) for a, b in zip(first, [*first[1:], len(shard)])]

    def __len__(self):
        return self.pairs.shape[1]

    def sample(self, share: float, seed) -> tuple[np.ndarray | None, np.ndarray | None]:
        """(rows of a round, how often each): None for all and for once."""
        if share >= 1:
            return None, None if self.n is None else self.n.astype(float)
        times = np.empty(len(self), bool if self.n is None else float)
        for shard, a, b in self.shards:
            rng = np.random.default_rng([*seed, shard])
            times[a:b] = rng.random(b - a) < share if self.n is None else rng.binomial(self.n[a:b], share)
        at = np.flatnonzero(times)
        return at, None if self.n is None else times[at]

    def above(self, feature: np.ndarray, cut: np.ndarray, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether row ``at[i]`` lies above the cut of its slot, in the slot's feature."""
        place = np.take((feature >> 1) * len(self), slot, mode="clip")
        place += at
        code = np.take(self.pairs.ravel(), place, mode="clip")
        code >>= np.take(np.where(feature & 1, 0, BITS).astype(np.uint16), slot, mode="clip")
        code &= BINS - 1
        return code > np.take(cut.astype(np.uint16), slot, mode="clip")

    def histograms(self, at: np.ndarray, slot: np.ndarray, times, y: np.ndarray, w, slots: int) -> np.ndarray:
        """(slots, features, BINS, 3): rows, weight and weighted sum of ``y`` per slot, feature and bin."""
        wide = slots << (2 * BITS)
        out = np.zeros((slots, 2 * len(self.pairs), BINS, 3))
        size = max(BLOCK, 4 * wide)
        blocks = []
        for i in range(0, len(at), size):
            own = slice(i, i + size)
            v, often = y[own], None if times is None else times[own]
            odd = extra = None
            if w is not None:
                odd = np.flatnonzero(w[own] != 1)
                extra = (w[own][odd] - 1) * (1 if often is None else often[odd])
                v = v * w[own]
            blocks.append((at[own], slot[own].astype(np.int32) << (2 * BITS), often, v if often is None else v * often, odd, extra))
        code, where = np.empty(min(size, len(at)), np.uint16), np.empty(min(size, len(at)), np.int64)
        for q, own in enumerate(self.pairs):
            n = more = total = 0
            for rows, base, often, v, odd, extra in blocks:
                c, p = code[:len(rows)], where[:len(rows)]
                np.take(own, rows, out=c, mode="clip")
                np.add(base, c, out=p)
                n = np.bincount(p, often, wide) + n
                total = np.bincount(p, v, wide) + total
                if odd is not None:
                    more = np.bincount(p[odd], extra, wide) + more
            for k, x in enumerate((n, n + more, total)):
                if np.ndim(x):
                    x = x.reshape(slots, BINS, BINS)
                    out[:, 2 * q, :, k], out[:, 2 * q + 1, :, k] = x.sum(2), x.sum(1)
        return out[:, :self.features]

    def leaves(self, tree: "Tree", at: np.ndarray) -> np.ndarray:
        """The leaf of each of the rows ``at``."""
        feature, cut, left = (np.asarray(x) for x in (tree.feature, tree.cut, tree.left))
        node = np.zeros(len(at), np.int64)
        live = np.arange(len(at)) if left[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            own = node[live]
            node[live] = left[own] + self.above(feature, cut, own, at[live])
            live = live[left[node[live]] >= 0]
        return node


class Tree:
    """Nodes parents first; the right child follows the left one, ``left`` < 0 marks a leaf."""

    def __init__(self):
        self.left, self.feature, self.cut, self.gain, self.stats, self.squares = [], [], [], [], [], None

    def add(self, stats) -> int:
        for own, x in ((self.left, -1), (self.feature, -1), (self.cut, -1), (self.gain, -1.0), (self.stats, tuple(float(v) for v in stats))):
            own.append(x)
        return len(self.left) - 1

    def values(self) -> np.ndarray:
        return np.array([s / w if w else 0.0 for _, w, s in self.stats])


def best_cuts(h: np.ndarray, drawn, smallest: int):
    """Per slot (feature or -1, cut, gain, sums left of it): the cut of largest gain among the drawn features."""
    left = h.cumsum(2)[:, :, :-1]
    total = h[:, 0].sum(1)[:, None, None]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[..., 2] ** 2 / left[..., 1] + right[..., 2] ** 2 / right[..., 1]
        gain = parts - total[..., 2] ** 2 / total[..., 1]
    fits = (left[..., 0] >= max(smallest, 1)) & (right[..., 0] >= max(smallest, 1)) & (gain > 1e-12 * np.abs(parts))
    if drawn is not None:
        fits &= drawn[:, :, None]
    gain = np.where(fits, gain, -1.0).reshape(len(h), -1)
    k = gain.argmax(1)
    slots = np.arange(len(h))
    feature, cut = np.divmod(k, left.shape[2])
    top = gain[slots, k]
    return np.where(top > 0, feature, -1), cut, top / np.maximum(total[:, 0, 0, 1], 1e-300), left[slots, feature, cut]


def grow(rows: Rows, at, slot, times, y, w, models: int, s: Settings, rng, everyone) -> tuple[list[Tree], np.ndarray]:
    """A tree for each model, grown side by side, and the leaf of each position.  Position i is row ``at[i]`` of
    model ``slot[i]``, ``times[i]`` copies of it, with residual ``y[i]``; ``everyone`` adds up the tasks' sums."""
    trees, leaf = [Tree() for _ in range(models)], np.zeros(len(at), np.int32)
    owner, number, live = np.arange(models), np.zeros(models, np.int64), np.arange(len(at))
    h = everyone(rows.histograms(at, slot, times, y, w, models))
    for m in range(models):
        trees[m].add(h[m, 0].sum(0))
    for depth in range(s.depth):
        drawn = None
        if s.drawn is not None and s.drawn < rows.features:
            drawn = np.zeros(h.shape[:2], bool)
            np.put_along_axis(drawn, rng.random(drawn.shape).argsort(1)[:, :s.drawn], True, 1)
        feature, cut, gain, low = best_cuts(h, drawn, s.smallest)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        high = h[split, 0].sum(1) - low[split]
        first = np.empty(len(split), np.int64)
        for i, k in enumerate(split):
            t = trees[owner[k]]
            t.left[number[k]], t.feature[number[k]], t.cut[number[k]], t.gain[number[k]] = len(t.left), int(feature[k]), int(cut[k]), float(gain[k])
            first[i] = t.add(low[k])
            t.add(high[i])
        place = np.full(len(h), -1)
        place[split] = np.arange(len(split))
        if len(split) < len(h):
            own = np.flatnonzero(np.take(place, slot, mode="clip") >= 0)
            live, slot = live[own], slot[own]
        goes_right = rows.above(feature, cut, slot, at[live])
        slot = np.take(place.astype(np.int32), slot, mode="clip")
        leaf[live] = np.take(first.astype(np.int32), slot, mode="clip") + goes_right
        if depth + 1 == s.depth:
            break
        right_small = high[:, 0] < low[split, 0]
        built = np.flatnonzero(goes_right == np.take(right_small, slot, mode="clip"))
        pick = live[built]
        small = everyone(rows.histograms(at[pick], slot[built], None if times is None else times[pick], y[pick], None if w is None else w[pick],
                                         len(split)))
        both = np.empty((2 * len(split), *h.shape[1:]))
        a = 2 * np.arange(len(split)) + right_small
        both[a], both[a ^ 1] = small, h[split] - small
        h, slot = both, 2 * slot + goes_right
        owner, number = np.repeat(owner[split], 2), np.column_stack([first, first + 1]).ravel()
    return trees, leaf


def auc_of(seen: np.ndarray) -> float | None:
    """ROC-AUC from (negatives, positives) per probability bin, ties half; None unless both occur."""
    neg, pos = seen
    if not neg.sum() or not pos.sum():
        return None
    return float((pos * (np.cumsum(neg) - neg + neg / 2)).sum() / (pos.sum() * neg.sum()))


def boost(rows: Rows, held: Rows, s: Settings, everyone) -> tuple[list[list[Tree]], list[float]]:
    """The models' trees, cut to the best round if there are both labels among the ``held`` rows, and its scores."""
    models = len(rows.y)
    margin, ahead = np.zeros(rows.y.shape), np.zeros(len(held))
    there = [np.flatnonzero(~np.isnan(y)) for y in rows.y]
    some = [len(a) < len(rows) for a in there]
    told = np.flatnonzero(~np.isnan(held.y[0]))
    trees, scores = [], []
    for k in range(s.rounds):
        at, times, slot, y = [], [], [], []
        for m in range(models):
            own, often = rows.sample(s.share, (s.seed, k, m))
            if own is None:
                own = there[m]
                often = None if often is None else often[own]
            elif some[m]:
                kept = ~np.isnan(rows.y[m][own])
                own, often = own[kept], None if often is None else often[kept]
            real, f = rows.y[m][own], margin[m][own]
            if k == 0:
                rest = real
            elif s.logistic:
                rest = 4 * real / (1 + np.exp(np.clip(2 * real * f, -700, 700)))
            else:
                rest = 2 * (real - f)
            at.append(own), times.append(often), slot.append(np.full(len(own), m, np.int32)), y.append(rest)
        sizes = [len(a) for a in at]
        at, slot, y = np.concatenate(at), np.concatenate(slot), np.concatenate(y)
        times = None if times[0] is None else np.concatenate(times)
        w = None if rows.w is None else rows.w[at]
        grown, leaf = grow(rows, at, slot, times, y, w, models, s, np.random.default_rng([s.seed, k, SHARDS, models]), everyone)
        weight = 1.0 if k == 0 else s.rate
        squares, start = [], 0
        most = 2 ** (s.depth + 1)
        wyy = y * y * (1 if w is None else w) * (1 if times is None else times)
        for m, t in enumerate(grown):
            mine = slice(start, start + sizes[m])
            start += sizes[m]
            values = weight * t.values()
            squares.append(np.bincount(leaf[mine], wyy[mine], most))
            margin[m][at[mine]] += values[leaf[mine]]
            if s.share < 1:
                rest = np.ones(len(rows), bool)
                rest[at[mine]] = False
                rest = np.flatnonzero(rest)
                margin[m][rest] += values[rows.leaves(t, rest)]
        seen = np.zeros((2, AUC_BINS))
        if s.patience:
            ahead += weight * grown[0].values()[held.leaves(grown[0], np.arange(len(held)))]
            p = 1 / (1 + np.exp(-2 * np.clip(ahead[told], -300, 300)))
            bins = np.minimum((p * AUC_BINS).astype(np.int64), AUC_BINS - 1) + AUC_BINS * (held.y[0][told] > 0)
            seen = np.bincount(bins, None if held.n is None else held.n[told], 2 * AUC_BINS).astype(float).reshape(2, AUC_BINS)
        closing = everyone(np.concatenate([np.concatenate(squares), seen.ravel()]))
        for m, t in enumerate(grown):
            t.squares = closing[m * most:(m + 1) * most][:len(t.left)].copy()
            for i in range(len(t.left) - 1, -1, -1):
                if t.left[i] >= 0:
                    t.squares[i] = t.squares[t.left[i]] + t.squares[t.left[i] + 1]
        trees.append(grown)
        score = auc_of(closing[models * most:].reshape(2, AUC_BINS)) if s.patience else None
        if score is not None:
            scores.append(score)
            if best_prefix(scores, s.patience)[1]:
                break
    keep = best_prefix(scores, s.patience)[0] if scores else len(trees)
    return [[t[m] for t in trees[:keep]] for m in range(models)], scores


# --- tasks -----------------------------------------------------------------------

class Exchange:
    """Adds up arrays of the same shape over all tasks, through files of a common folder; every task adds in the same
    order, so all have the same sums."""

    def __init__(self, folder: str, rank: int, tasks: int):
        self.folder, self.rank, self.tasks, self.turn = folder, rank, tasks, 0

    def path(self, turn: int, rank: int) -> str:
        return os.path.join(self.folder, f"{turn}-{rank}")

    def __call__(self, own: np.ndarray) -> np.ndarray:
        new = self.path(self.turn, self.rank)
        np.ascontiguousarray(own, float).tofile(new + ".part")
        os.replace(new + ".part", new)  # seen by others only when whole
        out = np.zeros(own.shape)
        for r in range(self.tasks):
            since, theirs = time.monotonic(), self.path(self.turn, r)
            while not os.path.exists(theirs):
                if time.monotonic() - since > SILENCE_S:
                    raise TimeoutError(f"no sums of task {r}")
                time.sleep(0.0005)
            out += np.fromfile(theirs).reshape(own.shape)
        if self.turn > 1:
            os.remove(self.path(self.turn - 2, self.rank))  # all have read it: they have sent their next sums
        self.turn += 1
        return out


def common_folder(context, candidates, name: str) -> str | None:
    """The first folder in which every task sees the files of all."""
    rank, tasks = context.partitionId(), len(context.getTaskInfos())
    for c in candidates:
        folder = os.path.join(c, name)
        try:
            os.makedirs(folder, exist_ok=True)
            open(os.path.join(folder, f"here-{rank}"), "w").close()
        except OSError:
            pass
        context.allGather("")
        seen = all(os.path.exists(os.path.join(folder, f"here-{r}")) for r in range(tasks))
        if all(json.loads(x) for x in context.allGather(json.dumps(seen))):
            return folder
        left_behind(folder, rank)
    return None


def left_behind(folder: str, rank: int) -> None:
    """Removes a task's files and, if it is the last, the folder."""
    try:
        for x in os.listdir(folder):
            if x.endswith(f"-{rank}"):
                os.remove(os.path.join(folder, x))
        os.rmdir(folder)
    except OSError:
        pass


def fit_trees(spark: SparkSession, rows: DataFrame, features, targets, s: Settings, weight: str | None = None, held: str | None = None):
    """(edges, per model its trees as rows of NODES, scores); raises NoCommonFolder if the tasks can't exchange sums."""
    names = list(features)
    edges = bin_edges(rows.where(~F.coalesce(F.col(held), F.lit(False))) if held else rows, names)
    x = stored(binned(rows, names, edges, targets, weight, held), "bins")
    size = x.count()
    alone, counted = size * len(names) * len(targets) <= ONE_TASK, few_cells(edges, targets)
    tasks = 1 if alone else slots(spark)
    if not alone and (tasks < 1 or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"):
        raise NoCommonFolder("no barrier stage")
    x = x.withColumn("_h", F.xxhash64("_bins", "_y", "_w")).withColumn("_s", F.pmod("_h", F.lit(SHARDS)).cast("int"))
    # equal rows are exchangeable, so ordering a shard by digest makes its sample depend on the rows alone
    x = x.repartition(tasks, F.col("_s")).sortWithinPartitions("_s", "_h").drop("_h")
    shared = checkpoint_dir(spark)
    shared = shared[5:] if shared.startswith("file:") else shared
    name, width = f"boost-{uuid.uuid4().hex}", len(names)

    def fit(batches):
        parts = []
        for b in batches:
            if b.num_rows:
                flat = np.frombuffer(b.column("_bins").buffers()[2], np.uint8)
                start = b.column("_bins").offset
                ends = np.frombuffer(b.column("_bins").buffers()[1], np.int32)[start:start + 1]
                bins = flat[ends[0]:ends[0] + b.num_rows * width].reshape(b.num_rows, width).copy()
                y = b.column("_y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                parts.append((bins, y, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("_w", "_n", "_s", "_held"))))
        if parts:
            bins, y, w, n, shard, out = (np.concatenate(p) for p in zip(*parts))
        else:
            bins, y, w, n, shard, out = np.zeros((0, width), np.uint8), np.zeros((0, len(targets))), np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        parts.clear()
        out = out.astype(bool)
        if s.logistic:
            if np.isnan(y[~out]).any():
                raise ValueError("a training row has no label")
            y = np.where(np.isnan(y), y, np.where(y == 1, 1.0, -1.0))
        own, others = (Rows(bins[k], np.ascontiguousarray(y[k].T), w[k], n[k] if counted else None, shard[k]) for k in (~out, out))
        del bins
        folder, context, first = None, None, True
        if tasks > 1:
            from pyspark import BarrierTaskContext
            context = BarrierTaskContext.get()
            first = context.partitionId() == 0
            folder = common_folder(context, [shared, tempfile.gettempdir()], f"{name}-{context.attemptNumber()}")
        everyone = (lambda a: a) if tasks == 1 else Exchange(folder, context.partitionId(), tasks) if folder else None
        if everyone is None:
            return
        models, scores = boost(own, others, s, everyone)
        if context:
            context.barrier()
            left_behind(folder, context.partitionId())
        if not first:
            return
        for m, trees in enumerate(models):
            for i, t in enumerate(trees):
                n, w, total = (list(v) for v in zip(*t.stats))
                right = [a + 1 if a >= 0 else -1 for a in t.left]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([i], pa.int32())] + [
                    pa.array([list(v)], pa.list_(kind)) for v, kind in zip(
                        (t.values().tolist(), t.left, right, t.feature, t.cut, t.gain, n, w, total, t.squares.tolist(), scores if i == 0 else []),
                        [pa.float64()] + [pa.int32()] * 4 + [pa.float64()] * 6)],
                    ["model", "tree", "prediction", "left", "right", "feature", "cut", "gain", "count", "weight", "total", "squares", "scores"])

    found = x.mapInArrow(fit, NODES, barrier=tasks > 1).collect()  # a row per tree
    if not found:
        raise NoCommonFolder("no folder is seen by all tasks")
    models = [sorted((r for r in found if r["model"] == m), key=lambda r: r["tree"]) for m in range(len(targets))]
    return edges, models, models[0][0]["scores"]


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


# --- Spark ML's model ---------------------------------------------------------------

def spark_model(spark: SparkSession, estimator, model_class, trees, edges, rate: float):
    """The fitted model of ``estimator`` (gradient-boosted trees) with these trees, through Spark ML's own file format."""
    path = scratch_path(spark, "boosted")
    estimator.write().save(f"{path}/estimator")
    own = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    java = own["class"].replace("GBTClassifier", "GBTClassificationModel").replace("GBTRegressor", "GBTRegressionModel")
    spark.createDataFrame([(json.dumps(own | {"class": java, "numFeatures": len(edges), "numTrees": len(trees)}),)], "value string") \
        .coalesce(1).write.text(f"{path}/model/metadata")
    one = {k: own[k] for k in ("timestamp", "sparkVersion")} | {
        "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": {
            k: v for k, v in own["paramMap"].items() if k in ("featuresCol", "labelCol", "maxDepth", "minInstancesPerNode", "seed")}, "defaultParamMap": {}}
    heads, nodes = [], []
    for i, t in enumerate(trees):
        heads.append((i, json.dumps(one | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if i == 0 else rate))
        for k in range(len(t["left"])):
            n, w, total, squares = (float(t[c][k]) for c in ("count", "weight", "total", "squares"))
            inner = t["left"][k] >= 0
            cut = (t["feature"][k], [edges[t["feature"][k]][t["cut"][k]]], -1) if inner else (-1, [], -1)
            spread = max((squares - total * total / w) / w, 0.0) if w else 0.0
            nodes.append((i, (k, t["prediction"][k], spread, [w, total, squares], int(n), t["gain"][k], t["left"][k], t["right"][k], cut)))
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    spark.createDataFrame(nodes, "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
                          "rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, "
                          "leftCategoriesOrThreshold: array<double>, numCategories: int>>").coalesce(1).write.parquet(f"{path}/model/data")
    return model_class.load(f"{path}/model")
