"""Trees boosted from binned rows."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.ml import boost, trees
from moldwatch.ml import models as ML
from moldwatch.session import materialize

FEATURES = ["a", "b", "c"]


def planted(spark, n=3000, values=20):
    """Whole numbers, so that both learners cut the same bins."""
    d = spark.range(n).select("id", *(F.floor(F.rand(k) * values).cast("double").alias(c) for k, c in enumerate(FEATURES)), F.rand(9).alias("r"),
                              (F.rand(10) < 0.3).alias("held"))
    d = d.withColumn("label", (F.col("a") + F.col("b") + 14 * F.col("r") > 1.2 * values).cast("int"))
    return materialize(d.withColumn("weight", F.when(F.col("label") == 1, 2.5).otherwise(1.0)).withColumn("y", F.col("a") * F.col("b") / 9 - F.col("c")))


def fitted(spark, d, targets=("label",), share=1.0, rounds=8, patience=0, depth=4, smallest=5, logistic=True, drawn=None):
    s = boost.Settings(rounds, 0.3, depth, smallest, share, drawn, logistic, patience)
    return boost.fit_trees(spark, d, FEATURES, list(targets), s, "weight" if logistic else None, "held" if patience else None)


def shape(models):
    return [[(t["left"], t["feature"], t["cut"], t["count"]) for t in m] for m in models]


def test_classifier_equals_spark_ml(spark):
    d = planted(spark)
    edges, (own,), _ = fitted(spark, d)
    x = VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(d.withColumn("label", F.col("label").cast("double")))
    learner = GBTClassifier(featuresCol="_f", labelCol="label", weightCol="weight", maxIter=8, stepSize=0.3, maxDepth=4, minInstancesPerNode=5, seed=1)
    theirs = learner.fit(x)
    model = boost.spark_model(spark, learner, type(theirs), own, edges, 0.3)
    p, q = ([r[0] for r in m.transform(x).orderBy("id").select(vector_to_array("probability")[1]).collect()] for m in (model, theirs))
    assert p == pytest.approx(q, abs=1e-9) and np.std(p) > 0.2
    assert model.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    assert model.treeWeights == theirs.treeWeights and model.getMaxIter() == 8
    a, b = model.trees[3], theirs.trees[3]
    assert a.numNodes == b.numNodes and a.depth == b.depth


def test_regressors_side_by_side_equal_spark_ml(spark):
    d = planted(spark).withColumn("z", F.when(F.col("id") % 7 > 0, F.col("c") * 2 + F.col("a")))
    edges, models, _ = fitted(spark, d, ("y", "z"), rounds=6, logistic=False, smallest=1, depth=5)
    x = VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(d)
    for target, own in zip(("y", "z"), models):
        learner = GBTRegressor(featuresCol="_f", labelCol=target, maxIter=6, stepSize=0.3, maxDepth=5, seed=1)
        theirs = learner.fit(x.where(F.col(target).isNotNull()))
        model = boost.spark_model(spark, learner, type(theirs), own, edges, 0.3)
        p, q = ([r["prediction"] for r in m.transform(x).orderBy("id").select("prediction").collect()] for m in (model, theirs))
        assert p == pytest.approx(q, abs=1e-8)


@pytest.mark.parametrize("counted", [True, False])
def test_tasks_together_grow_the_trees_of_one_task(spark, monkeypatch, counted):
    """With samples of rows and features and held-out rows; neither partitions nor order matter."""
    if not counted:
        monkeypatch.setattr(boost, "CELLS", 1)
    d = planted(spark, values=40)
    args = dict(share=0.8, drawn=2, patience=4, rounds=10)
    _, one, scores = fitted(spark, d, **args)
    _, again, _ = fitted(spark, d.orderBy("r").repartition(7), **args)
    monkeypatch.setattr(boost, "ONE_TASK", 0)
    _, together, others = fitted(spark, d, **args)
    assert shape(one) == shape(again) == shape(together) and 1 <= len(one[0]) <= len(scores) <= 10
    assert scores == pytest.approx(others, abs=1e-12)
    own = sum(c for c in one[0][0]["count"][:1])
    assert 0.7 < own / d.where("not held").count() < 0.9


def test_rounds_are_not_jobs(spark):
    """Spark ML ran some jobs for each level of each tree."""
    d, scheduler = planted(spark, 500), spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    model = ML.train_gbt(d, FEATURES)
    assert model.stages[-1].getNumTrees == 500 and scheduler.numTotalJobs() - before < 60


def test_equal_rows_are_counted(spark):
    d = planted(spark, 400, values=5)
    copied = d.crossJoin(spark.range(30).select(F.col("id").alias("copy")))
    edges = boost.bin_edges(copied, FEATURES)
    assert edges == boost.bin_edges(d, FEATURES) == [[0.5, 1.5, 2.5, 3.5]] * 3
    cells = boost.binned(copied, FEATURES, edges, ["label"], "weight", None)
    assert cells.count() <= 250 and cells.agg(F.sum("_n")).first()[0] == 12000
    _, (one,), _ = fitted(spark, d, smallest=1)
    _, (many,), _ = fitted(spark, copied, smallest=30)
    assert [(t["left"], t["feature"], t["cut"]) for t in one] == [(t["left"], t["feature"], t["cut"]) for t in many]


def test_edges(spark):
    d = spark.range(20000).select((F.col("id") * 7919 % 20000).cast("double").alias("x"), F.lit(3.0).alias("one"),
                                  F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") / 3.0).alias("half"))
    x, one, half = boost.bin_edges(d.repartition(5), ["x", "one", "half"])
    sizes = np.diff(np.searchsorted(np.arange(20000.0), [0, *x, 20000]))
    assert len(x) == 31 and sizes.min() > 450 and sizes.max() < 800 and one == []
    assert half == sorted(set(half)) and 0 <= half[0] < 20000 / 60 and len(half) >= 15  # half of the rows share a bin
    assert boost.bin_edges(d.limit(0), ["x"]) == [[]]


def test_without_a_common_folder_spark_ml_fits(spark, monkeypatch):
    def none(*_):
        raise boost.NoCommonFolder

    monkeypatch.setattr(boost, "fit_trees", none)
    monkeypatch.setitem(config.BOOSTING_PRESETS, "retrain_v2", (4, 0.3, 7, 5, 40, 2))
    assert 1 <= ML.train_gbt(planted(spark, 300), FEATURES, validation_col="held").stages[-1].getNumTrees <= 4


def test_scores_are_those_of_the_model(spark):
    d = planted(spark)
    edges, (own,), scores = fitted(spark, d, share=0.8, patience=9, rounds=9)
    x = d.where("not held").withColumn("label", F.col("label").cast("double"))
    learner = GBTClassifier(featuresCol="_f", labelCol="label", maxIter=9, stepSize=0.3, maxDepth=4)
    theirs = learner.fit(VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(x))
    model = boost.spark_model(spark, learner, type(theirs), own, edges, 0.3)
    staged = trees.staged_auc(d.where("held"), trees.forest_of(spark, model), FEATURES)
    assert staged == pytest.approx(scores[:len(own)], abs=1e-12) and max(scores) > 0.8


def test_no_files_are_left(spark, monkeypatch):
    import os
    import tempfile

    from moldwatch.session import checkpoint_dir
    monkeypatch.setattr(boost, "ONE_TASK", 0)
    folders = [checkpoint_dir(spark).removeprefix("file:"), tempfile.gettempdir()]

    def there():
        return {x for f in folders for x in os.listdir(f) if x.startswith("boost-")}

    before = there()
    fitted(spark, planted(spark, 200), rounds=2)
    assert there() == before


def test_a_task_that_is_silent_is_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(boost, "SILENCE_S", 0.05)
    with pytest.raises(TimeoutError):
        boost.Exchange(str(tmp_path), 0, 2)(np.ones(3))


def test_constant_and_missing_rows(spark):
    d = planted(spark, 200).withColumn("label", F.lit(1))
    _, (own,), _ = fitted(spark, d)
    assert [t["left"] for t in own] == [[-1]] * 8 and own[0]["prediction"] == [1.0]
    with pytest.raises(Exception, match="no label"):
        fitted(spark, d.withColumn("label", F.when(F.col("id") > 3, 1)))


def test_presets_share_the_filled_history(spark, monkeypatch):
    from moldwatch.plans import fixtures, queries_forecast, training
    for preset, (_, *rest) in list(config.FORECASTER_PRESETS.items()):
        monkeypatch.setitem(config.FORECASTER_PRESETS, preset, (2, *rest))
    training.clear_caches()
    made, own = [], fixtures.history
    monkeypatch.setattr(fixtures, "history", lambda *a: made.append(a) or own(*a))
    found = queries_forecast.tree_forecasters(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and {len(f.weight) for forests, *_ in found.values() for f in forests.values()} == {2}
    training.clear_caches()
