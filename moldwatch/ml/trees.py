"""Boosted trees as arrays: staged scores, early stopping with patience, recursion (ML1, ML6, M3).

A fitted ensemble is saved in the shared folder and its node table read back: at most
rounds x 2^(depth + 1) rows, bounded by the preset and not by the data.  As numpy arrays the nodes travel
to the tasks, where whole batches walk all trees at once.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moldwatch.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

AUC_BINS = 4096  # probabilities closer than 1 / AUC_BINS count as ties
ROWS = 1024      # rows that walk all trees together


@dataclass
class Forest:
    """Trees side by side, padded to the widest: ``left[t, i]`` < 0 marks a leaf."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Weighted leaf values, a row per row of ``x`` and a column per tree."""
        trees = np.arange(len(self.weight))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.left[trees, at] >= 0
        while inner.any():
            f = np.where(inner, self.feature[trees, at], 0)
            goes_left = x[rows, f] <= self.threshold[trees, at]  # NaN goes right
            at = np.where(inner, np.where(goes_left, self.left[trees, at], self.right[trees, at]), at)
            inner = self.left[trees, at] >= 0
        return self.value[trees, at] * self.weight

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees (a regression's prediction, a classifier's margin)."""
        out = np.zeros(len(x))
        for k in range(0, len(x), ROWS):
            out[k:k + ROWS] = self.leaves(x[k:k + ROWS]).sum(axis=1)
        return out


def forest_from_nodes(nodes, weights) -> Forest:
    """``nodes``: (tree, node, prediction, left, right, feature, threshold) with left = -1 for leaves."""
    own = sorted(nodes)
    trees = len(weights)
    width = max((n[1] for n in own), default=0) + 1
    feature, left, right = (np.full((trees, width), -1, np.int64) for _ in range(3))
    threshold, value = np.zeros((trees, width)), np.zeros((trees, width))
    for t, i, prediction, lo, hi, f, cut in own:
        value[t, i], left[t, i], right[t, i] = prediction, lo, hi
        if lo >= 0:
            feature[t, i], threshold[t, i] = f, cut
    return Forest(feature, threshold, left, right, value, np.asarray(weights, float))


def forest_of(spark: SparkSession, model) -> Forest:
    """The trees of a fitted boosted model without categorical features."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("cut"),
        n["split"]["numCategories"].alias("categories")).collect()
    if any(r["left"] >= 0 and r["categories"] != -1 for r in rows):
        raise ValueError("categorical splits are not supported")
    return forest_from_nodes([(r["treeID"], r["id"], r["prediction"], r["left"], r["right"], r["feature"], r["cut"][0] if r["cut"] else 0.0)
                              for r in rows], model.treeWeights)


def staged_auc(df: DataFrame, forest: Forest, features, label: str = "label") -> list[float] | None:
    """ROC-AUC of the classifier cut after 1, 2, ... rounds, over ``df`` in one pass; None
    unless both labels occur.  Tasks send counts per round and probability bin, so what is
    shuffled does not grow with the rows; ties inside a bin count half."""
    rounds, names = len(forest.weight), list(features)

    def count(batches):
        seen = np.zeros((2, rounds, AUC_BINS), np.int64)
        stage = np.arange(rounds)
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if b.num_rows else np.zeros((0, 1))
            y = b.column("_y").to_numpy(zero_copy_only=False)
            for k in range(0, len(x), ROWS):
                margin = np.cumsum(forest.leaves(x[k:k + ROWS]), axis=1)
                p = 1 / (1 + np.exp(-2 * np.clip(margin, -300, 300)))
                bins = np.minimum((p * AUC_BINS).astype(np.int64), AUC_BINS - 1)
                for own, i in zip(bins, y[k:k + ROWS]):
                    seen[int(i), stage, own] += 1
        r, b = np.nonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(seen[1, r, b]),
                                          pa.array(seen[0, r, b])], ["round", "bin", "pos", "neg"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names], (F.col(label) == 1).cast("int").alias("_y"))
    bins = rows.where(F.col("_y").isNotNull()).mapInArrow(count, "round int, bin int, pos bigint, neg bigint").groupBy("round", "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("round").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_round = bins.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).groupBy("round").agg(
        F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()  # a row per round
    if not per_round or not per_round[0]["p"] or not per_round[0]["n"]:
        return None
    return [r["won"] / (r["p"] * r["n"]) for r in sorted(per_round)]


def best_prefix(scores, patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether boosting has stopped): rounds count from 1, the first of equal
    scores is the best, and boosting stops once ``patience`` rounds have not beaten it."""
    best = 0
    for i, s in enumerate(scores):
        if s > scores[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(spark: SparkSession, model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The classifier made of the first ``rounds`` trees."""
    if rounds >= model.getNumTrees:
        return model
    java = model._java_obj
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i, tree in enumerate(java.trees()[:rounds]):
        trees[i], weights[i] = tree, float(model.treeWeights[i])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2)
    return model._copyValues(GBTClassificationModel(cut))


def boost_with_patience(fit, train: DataFrame, validation: DataFrame, features, label: str, rounds: int, patience: int):
    """A classifier cut to its best round by validation AUC.  ``fit(train, n)`` boosts n rounds; the
    first trees of a longer run are those of a shorter one, so runs of growing length end as one of all
    rounds would.  A run that was still gaining in the last half of the rounds to wait is followed by one
    of all rounds, else by one of twice its length: each run starts anew, and where the AUC rises to the
    end, doubling would fit more than twice the rounds that there are.
    Returns (model, AUC of every round that was tried); without both labels in the
    validation rows all rounds are kept."""
    tried = min(rounds, patience + patience // 2)
    while True:
        model = fit(train, tried)
        scores = staged_auc(validation, forest_of(train.sparkSession, model), features, label)
        if scores is None:
            return (model if tried == rounds else fit(train, rounds)), []
        keep, stopped = best_prefix(scores, patience)
        if stopped or tried == rounds:
            return truncated(train.sparkSession, model, keep), scores
        tried = rounds if tried - keep < patience // 2 else min(rounds, 2 * tried)
