"""Random forest on cells (ML2).

A tree learner that cuts every feature into at most BINS bins sees nothing of a row but its bins and its
label.  Rows are therefore counted per cell, a combination of bins, in one aggregation; there are at most
CELLS cells by definition, however many rows.  A row enters a tree's bootstrap Poisson(1) times, so n
equal rows enter it Poisson(n) times together, and trees grown from cells follow the same distribution as those
grown from rows.  Each tree is drawn and grown by a task of its own from the broadcast cells; the trees' nodes (bounded
by number and depth of the trees) come back, and a row's probability is looked up by its cell.

Growth follows Spark ML's forest: level by level, ceil(sqrt(features)) features drawn for each node, the cut of largest
Gini gain if that is above 0, leaves of one parent that predict the same class merged.  Bins hold about equal
numbers of rows; a feature with at most BINS values gets a bin for each.  Seeded by tree, so the
result depends on neither the order nor the partitions of the rows.
"""
from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moldwatch.ml.trees import Forest, forest_from_nodes
from moldwatch.operators.stats import PER_UNIT, mono_bucket

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

BINS = 32        # Spark ML's maxBins
CELLS = 1 << 20
TASKS = 64
NODE = "tree int, prediction array<double>, left array<int>, right array<int>, feature array<int>, cut array<int>"


def bin_edges(rows: DataFrame, features) -> list[list[float]]:
    """Per feature the upper edges of all bins but the last.  Values are counted per bucket of a fixed monotone
    rule; neighbouring buckets are put together, and edges lie midway between the bins' values."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"))
                                           for i, c in enumerate(features)])).alias("x")).select("x.*")
    counts = long.groupBy("i", mono_bucket(F.col("v"), PER_UNIT).alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    own, before = Window.partitionBy("i"), Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    share = F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) * BINS / F.sum("c").over(own))
    at = F.when(F.count(F.lit(1)).over(own) <= BINS, F.row_number().over(Window.partitionBy("i").orderBy("b"))).otherwise(share)
    bins = counts.withColumn("at", at).groupBy("i", "at").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx")).collect()
    edges = []
    for i in range(len(features)):
        own_bins = sorted((r["mn"], r["mx"]) for r in bins if r["i"] == i)
        mids = [(a[1], a[1] / 2 + b[0] / 2, b[0]) for a, b in zip(own_bins, own_bins[1:])]
        edges.append([mid if low <= mid < high else low for low, mid, high in mids])
    return edges


def with_cell(df: DataFrame, features, edges, out: str = "_cell") -> DataFrame:
    """``df`` with the number of each row's cell."""
    code = F.lit(0).cast("int")
    for c, own in zip(features, edges):
        nth = F.lit(0)
        for e in own:
            nth = nth + (F.col(c) > F.lit(e)).cast("int")
        code = code * F.lit(len(own) + 1) + nth
    return df.withColumn(out, code)


def bins_of(cells: np.ndarray, sizes) -> np.ndarray:
    """The bins of cells, a column per feature."""
    found = np.empty((len(cells), len(sizes)), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        cells, found[:, j] = np.divmod(cells, sizes[j])
    return found


def grow(bins: np.ndarray, weights: np.ndarray, max_depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree from cells with (class 0, class 1) weights: prediction (share of class 1), left, right (-1: leaf), feature,
    cut (bins up to it go left) per node, merged as Spark ML merges."""
    n_features = bins.shape[1]
    n_drawn, width = math.ceil(math.sqrt(n_features)), int(bins.max(initial=0)) + 1
    rows = np.flatnonzero(weights.sum(1) > 0)
    bins, w0, w1 = bins[rows], weights[rows, 0].astype(float), weights[rows, 1].astype(float)
    node, m, made = np.zeros(len(rows), np.int64), 1, 0
    levels = []
    for depth in range(max_depth + 1):
        t0, t1 = np.bincount(node, w0, m), np.bincount(node, w1, m)
        total = np.maximum(t0 + t1, 1)
        level = [t1 / total, np.full(m, -1), np.full(m, -1), np.full(m, -1), np.full(m, -1)]
        levels.append(level)
        made += m
        if depth == max_depth:
            break
        drawn = np.zeros((m, n_features), bool)
        np.put_along_axis(drawn, rng.random((m, n_features)).argsort(1)[:, :n_drawn], True, 1)
        best, feature, cut = np.zeros(m), level[3], level[4]
        for j in range(n_features):
            at = node * width + bins[:, j]
            l0, l1 = (np.bincount(at, w, m * width).reshape(m, width).cumsum(1)[:, :-1] for w in (w0, w1))
            r0, r1 = t0[:, None] - l0, t1[:, None] - l1
            left, right = l0 + l1, r0 + r1
            gain = (2 * t0 * t1 / total)[:, None] - 2 * l0 * l1 / np.maximum(left, 1) - 2 * r0 * r1 / np.maximum(right, 1)
            gain = np.where((left > 0) & (right > 0) & drawn[:, j, None], gain / total[:, None], -1.0)
            k = gain.argmax(1) if width > 1 else np.zeros(m, np.int64)
            top = gain[np.arange(m), k] if width > 1 else np.zeros(m)
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, k[better]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        level[1][split] = made + 2 * np.arange(len(split))
        level[2][split] = level[1][split] + 1
        own = feature[node] >= 0
        node, bins, w0, w1 = node[own], bins[own], w0[own], w1[own]
        goes_right = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = level[1][node] - made + goes_right
        m = 2 * len(split)
    return _merged(*(np.concatenate(x) for x in zip(*levels)))


def _merged(prediction, left, right, feature, cut):
    """Leaves of one parent that predict the same class become one; nodes numbered anew, parents first."""
    leaf = left < 0
    for i in range(len(left) - 1, -1, -1):
        if not leaf[i] and leaf[left[i]] and leaf[right[i]] and (prediction[left[i]] > 0.5) == (prediction[right[i]] > 0.5):
            leaf[i] = True
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for i in np.flatnonzero(~leaf):
        kept[left[i]] = kept[right[i]] = kept[i]
    inner = ~leaf & kept
    number = np.cumsum(kept) - 1
    left, right = np.where(inner, number[left], -1), np.where(inner, number[right], -1)
    return prediction[kept], left[kept], right[kept], np.where(inner, feature, -1)[kept], np.where(inner, cut, -1)[kept]


@dataclass
class CellForest:
    """A fitted forest: its features, their bin edges and the trees over bins."""
    features: list[str]
    edges: list[list[float]]
    trees: Forest

    def transform(self, df: DataFrame, prob_col: str) -> DataFrame:
        """``df`` with the class-1 probability; the probability of every cell is tabulated once."""
        sizes, trees = [len(e) + 1 for e in self.edges], self.trees

        def tabulate(batches):
            for b in batches:
                cells = b.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(trees.predict(bins_of(cells, sizes)))],
                                                 ["_cell", prob_col])

        n = math.prod(sizes)
        table = df.sparkSession.range(0, n, 1, min(TASKS, n)).mapInArrow(tabulate, f"_cell int, `{prob_col}` double")
        return with_cell(df, self.features, self.edges).join(F.broadcast(table), "_cell").drop("_cell")


def fit_cells(rows: DataFrame, features, label: str, edges, num_trees: int, max_depth: int, seed: int) -> CellForest:
    """``num_trees`` trees from ``rows`` without null features; those without a label are left out."""
    spark: SparkSession = rows.sparkSession
    sizes = [len(e) + 1 for e in edges]
    one = F.col(label) == 1
    counts = with_cell(rows.where(F.col(label).isNotNull()), features, edges).groupBy("_cell").agg(
        F.sum((~one).cast("long")).alias("n0"), F.sum(one.cast("long")).alias("n1")).toArrow()  # a row per cell
    order = np.argsort(counts["_cell"].to_numpy())
    if not len(order):
        raise ValueError("a forest needs rows with a label")
    cells = spark.sparkContext.broadcast(tuple(counts[c].to_numpy()[order] for c in ("_cell", "n0", "n1")))

    def fit(batches):
        cell, n0, n1 = cells.value
        bins, n = bins_of(cell.astype(np.int64), sizes), np.column_stack([n0, n1])
        for b in batches:
            for t in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, t])
                tree = grow(bins, rng.poisson(n), max_depth, rng)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(
                    pa.array([x.tolist()], pa.list_(kind)) for x, kind in zip(tree, [pa.float64()] + [pa.int32()] * 4))],
                    ["tree", "prediction", "left", "right", "feature", "cut"])

    nodes = []
    for r in spark.range(0, num_trees, 1, min(TASKS, num_trees)).mapInArrow(fit, NODE).collect():  # a row per tree
        nodes += [(r["tree"], i, *x) for i, x in enumerate(zip(r["prediction"], r["left"], r["right"], r["feature"], r["cut"]))]
    cells.destroy()
    return CellForest(list(features), edges, forest_from_nodes(nodes, [1 / num_trees] * num_trees))
