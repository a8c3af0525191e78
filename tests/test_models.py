"""Boosting presets and the tree forecaster."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.ml import models as ML
from moldwatch.ml import trees
from moldwatch.operators.rolling import lag_features
from moldwatch.session import materialize

# preset: rounds, rate, leaves, smallest leaf, weight cap, patience
PUBLISHED = {"retrain_v2": (500, 0.05, 31, 20, 40, 50), "retrain_v1_2e": (500, 0.05, 63, 10, 50, 50),
             "retrain_v1_2d": (500, 0.05, 31, 10, 30, 50), "build_v1_2b": (1000, 0.02, 64, 50, 50, 30),
             "wide_v1_1": (500, 0.05, 64, 20, 100, 50), "wide": (500, 0.05, 64, 20, None, 50)}


@pytest.mark.parametrize("name", sorted(PUBLISHED))
def test_presets(name):
    rounds, rate, leaves, smallest, cap, _ = PUBLISHED[name]
    assert config.BOOSTING_PRESETS[name] == PUBLISHED[name]
    p = ML.gbt_params(name)
    assert (p["maxIter"], p["stepSize"], p["minInstancesPerNode"], ML.weight_cap(name)) == (rounds, rate, smallest, cap)
    assert 2 ** (p["maxDepth"] - 1) < leaves <= 2 ** p["maxDepth"]
    assert (p["subsamplingRate"], p["featureSubsetStrategy"]) == (0.8, "0.8")


def test_tree_forecaster_learns_a_cycle(spark, monkeypatch):
    monkeypatch.setitem(config.FORECASTER_PRESETS, "lagged", (10, 0.3, 4, 5))
    rows = [("M1", i, float(i % 6), float((i + 2) % 6)) for i in range(300)]
    w = spark.createDataFrame(rows, "machine_id string, s bigint, a double, b double").select(
        "machine_id", F.timestamp_seconds("s").alias("timestamp"), "a", "b")
    lagged = lag_features(w, ["a", "b"], 5).cache()
    models = ML.fit_tree_forecaster(lagged, ["a", "b"], "lagged")
    out = ML.forecast_one_step(models, lagged)
    worst = out.agg(F.max(F.abs(F.col("a_forecast") - F.col("a_next"))), F.max(F.abs(F.col("b_forecast") - F.col("b_next")))).first()
    assert max(worst) < 0.5


def auc(pairs):
    """Share of (positive, negative) pairs that are in order, ties half."""
    pos, neg = ([p for p, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_best_prefix():
    assert trees.best_prefix([.5, .6, .6, .7, .7, .69, .68], 3) == (4, True)
    assert trees.best_prefix([.5, .6, .6, .7, .7, .69], 3) == (4, False)
    assert trees.best_prefix([.9, .1, .95], 1) == (1, True)
    assert trees.best_prefix([.9, .1, .95], 2) == (3, False)
    assert trees.best_prefix([.5], 50) == (1, False)


def noisy(spark, n=600):
    d = spark.range(n).select("id", *(F.rand(k).alias(f"x{k}") for k in range(4)), F.rand(9).alias("r"))
    return materialize(d.select(
        "id", "x0", "x1", F.when(F.col("id") % 50 == 7, None).otherwise(F.col("x2")).alias("x2"), "x3",
        ((F.col("x0") + F.col("x1") + 0.8 * F.col("r")) > 1.5).cast("int").alias("label"), F.lit(1.0).alias("weight"),
        (F.col("id") % 3 == 0).alias("held")))


FEATURES = ["x0", "x1", "x2", "x3"]


def staged_by_hand(model, rows):
    """Per round (p, label) of every row, from the trees that Spark itself evaluates."""
    gbt = model.stages[-1]
    vectors = [model.stages[0].transform(ML.filled(rows, FEATURES)).select("_features", "label").collect()][0]
    leaf = [[t.predict(v["_features"]) * w for v in vectors] for t, w in zip(gbt.trees, gbt.treeWeights)]
    out, margin = [], [0.0] * len(vectors)
    for one in leaf:
        margin = [m + x for m, x in zip(margin, one)]
        p = [1 / (1 + math.exp(-2 * m)) for m in margin]
        out.append([(int(q * trees.AUC_BINS), v["label"]) for q, v in zip(p, vectors)])
    return out


def test_boosting_keeps_the_best_round(spark, monkeypatch):
    d = noisy(spark)
    whole = dict(PUBLISHED)["retrain_v2"]
    monkeypatch.setitem(config.BOOSTING_PRESETS, "retrain_v2", (24, 0.3, *whole[2:5], 6))
    asm_all = ML.train_gbt(d.where(~F.col("held")), FEATURES, preset="retrain_v2")
    assert asm_all.stages[-1].getNumTrees == 24
    scores = [auc(s) for s in staged_by_hand(asm_all, d.where("held"))]
    forest = trees.forest_of(spark, asm_all.stages[-1])
    assert trees.staged_auc(ML.filled(d.where("held"), FEATURES), forest, FEATURES) == pytest.approx(scores, abs=1e-12)
    keep, _ = trees.best_prefix(scores, 6)
    model = ML.train_gbt(d, FEATURES, validation_col="held", preset="retrain_v2")
    gbt = model.stages[-1]
    assert 1 < keep == gbt.getNumTrees < 24
    for a, b in zip(gbt.trees, asm_all.stages[-1].trees):
        assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    assert len(gbt.featureImportances) == 4
    p = {r["id"]: r["scrap_probability"] for r in ML.score(model, d).collect()}
    x = np.array([[r[c] or 0.0 for c in FEATURES] for r in d.orderBy("id").collect()], float)
    cut = trees.forest_of(spark, gbt)
    want = 1 / (1 + np.exp(-2 * cut.predict(x)))
    assert [p[i] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-12)


@pytest.mark.parametrize("best, keep, most", [(490, 490, 575), (40, 40, 225), (185, 185, 575), (10, 10, 75)])
def test_boosting_anew_costs_little_more_than_all_rounds(monkeypatch, best, keep, most):
    """Where the AUC rises to the end, the runs together have few more rounds than there are."""
    fitted = []

    class Model:
        sparkSession = None

        def __init__(self, n):
            self.getNumTrees = n

    def fit(_, n):
        fitted.append(n)
        return Model(n)

    monkeypatch.setattr(trees, "forest_of", lambda _, model: model)
    monkeypatch.setattr(trees, "staged_auc", lambda _, model, *__: [0.9 - abs(best - 1 - i) / 1000 for i in range(model.getNumTrees)])
    monkeypatch.setattr(trees, "truncated", lambda _, model, rounds: rounds)
    kept, scores = trees.boost_with_patience(fit, Model(0), None, [], "label", 500, 50)
    assert kept == keep and sum(fitted) <= most and len(scores) == fitted[-1]


def test_boosting_without_both_labels_keeps_all_rounds(spark, monkeypatch):
    d = noisy(spark, 200).withColumn("held", F.col("label") == 0).withColumn("held", F.col("held") & (F.col("id") % 2 == 0))
    monkeypatch.setitem(config.BOOSTING_PRESETS, "retrain_v2", (5, 0.3, 7, 5, 40, 2))
    assert ML.train_gbt(d, FEATURES, validation_col="held").stages[-1].getNumTrees == 5


def test_planted_signal_with_the_presets_own_rounds(spark):
    d = noisy(spark, 900)
    model = ML.train_gbt(d, FEATURES, validation_col="held", preset="retrain_v2")
    assert 1 < model.stages[-1].getNumTrees < 500
    pairs = [(r["scrap_probability"], r["label"]) for r in ML.score(model, d.where("held")).collect()]
    assert auc(pairs) > 0.85


def test_training_table_is_computed_once(spark, monkeypatch):
    """The model, its scores and the latest rows all read one stored table."""
    from moldwatch.plans import queries_ml, training
    monkeypatch.setitem(config.BOOSTING_PRESETS, "retrain_v2", (2, *config.BOOSTING_PRESETS["retrain_v2"][1:]))
    training.clear_caches()
    made, own = [], training.training_table
    monkeypatch.setattr(training, "training_table", lambda *a: made.append(a) or own(*a))
    sf = "/root/testdata/sf0.001"
    assert queries_ml.q_explain(spark, sf).count() > 0
    assert queries_ml.q_model_scores(spark, sf).count() > 0
    assert len(made) == 1
    training.clear_caches()


def test_forecaster_presets_are_fitted_side_by_side(spark, monkeypatch):
    import threading
    from moldwatch.plans import queries_forecast
    both = threading.Barrier(len(config.FORECASTER_PRESETS), timeout=30)

    def fit(session, sf, preset):
        both.wait()  # breaks unless all presets are here at once
        return preset, sf

    monkeypatch.setattr(queries_forecast, "tree_forecaster", fit)
    assert queries_forecast.tree_forecasters(spark, "x") == {p: (p, "x") for p in config.FORECASTER_PRESETS}


def test_training_features_are_stored_as_one_column(spark):
    """Stored, split and joined as one array; the table that is read has the values of all columns."""
    from moldwatch.plans import training
    sf = "/root/testdata/sf0.001"
    training.clear_caches()
    narrow, feats = training.packed_table(spark, sf), training.feature_columns()
    assert narrow.columns == ["machine_id", "timestamp", training.LABEL, "_cells"]
    kept, made = (t.orderBy("machine_id", "timestamp").toPandas() for t in (training.kept_table(spark, sf), training.training_table(spark, sf)))
    assert list(kept.columns) == list(made.columns) == [*narrow.columns[:3], *feats]
    assert kept.equals(made) and kept[feats].to_numpy().any(axis=0).sum() > 60
    training.clear_caches()


def test_packed_columns_come_back_with_their_nulls(spark):
    from moldwatch.plans import training
    d = spark.createDataFrame([(1, 1.5, None), (2, None, float("nan"))], "id int, a double, b double")
    p = training.packed(d, ["a", "b"], keep=["a"])
    assert p.columns == ["id", "a", "_cells"]
    rows = training.unpacked(p, ["a", "b"]).orderBy("id").collect()
    assert (rows[0]["a"], rows[0]["b"], rows[1]["a"]) == (1.5, None, None) and math.isnan(rows[1]["b"])


def test_wide_features_take_the_largest_last_of_equal_times(spark):
    from moldwatch.operators.rolling import long_to_wide_features
    rows = [("M1", "a", "6h", 1, 2.0, 1.0), ("M1", "a", "6h", 1, 2.0, 9.0), ("M1", "b", "1d", 1, None, 3.0), ("M1", "x", "6h", 2, 5.0, 5.0)]
    d = spark.createDataFrame(rows, "machine_id string, variable_name string, `window` string, timestamp int, mean double, last double").coalesce(1)
    wide = long_to_wide_features(d, ["a", "b"], [("6h", 1), ("1d", 2)], stats=("mean", "last"))
    assert wide.columns == ["machine_id", "timestamp"] + [f"{s}__{st}_{w}" for s in "ab" for w in ("6h", "1d") for st in ("mean", "last")]
    got = {r["timestamp"]: r.asDict() for r in wide.collect()}
    assert got[1]["a__mean_6h"] == 2.0 and got[1]["a__last_6h"] == 9.0 and got[1]["b__last_1d"] == 3.0 and got[1]["b__mean_1d"] is None
    assert set(list(got[2].values())[2:]) == {None}  # the reading of another sensor
