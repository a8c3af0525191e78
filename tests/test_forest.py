"""The random forest grown from cells."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from moldwatch.ml import forest
from moldwatch.ml import models as ML
from moldwatch.session import materialize

FEATURES = ["a", "b", "c", "d"]


def planted(spark, n=4000):
    d = spark.range(n).select("id", F.rand(1).alias("a"), F.round(F.rand(2) * 10).alias("b"), F.rand(3).alias("c"),
                              F.when(F.col("id") % 9 > 0, F.rand(4)).alias("d"), F.rand(5).alias("r"))
    return materialize(d.withColumn("label", (F.col("a") + F.col("b") / 10 + 0.8 * F.col("r") > 1.4).cast("int")))


def test_agrees_with_the_forest_grown_from_rows(spark):
    d = planted(spark)
    model = ML.train_random_forest(d, FEATURES, num_trees=150, max_depth=6)
    assert isinstance(model, forest.CellForest)
    asm = VectorAssembler(inputCols=FEATURES, outputCol="_f")
    rows = ML.filled(d, FEATURES)
    spark_ml = Pipeline(stages=[asm, RandomForestClassifier(featuresCol="_f", labelCol="label", numTrees=150, maxDepth=6, seed=1)]).fit(rows)
    theirs = spark_ml.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
    own = ML.score(model, d).select("id", "a", "d", F.col("scrap_probability").alias("q"), "predicted_scrap")
    both = own.join(theirs, "id").toPandas()
    assert len(both) == d.count() and both["d"].isna().any()
    assert (both.q - both.p).abs().mean() < 0.02 and abs(both.q.mean() - both.p.mean()) < 0.01
    assert ((both.q >= 0.5) == (both.predicted_scrap == 1)).all()


def test_same_forest_for_any_partitions_and_fewer_rows_than_copies(spark):
    d = planted(spark, 500)
    one, other = (ML.score(ML.train_random_forest(x, FEATURES, num_trees=10), d).orderBy("id").toPandas()["scrap_probability"]
                  for x in (d, d.repartition(7)))
    assert (one == other).all()
    cells = forest.with_cell(ML.filled(d, FEATURES), FEATURES, forest.bin_edges(ML.filled(d, FEATURES), FEATURES))
    copied = d.crossJoin(spark.range(40).select(F.col("id").alias("copy")))
    again = ML.filled(copied, FEATURES)
    assert forest.bin_edges(again, FEATURES) == forest.bin_edges(ML.filled(d, FEATURES), FEATURES)
    assert cells.select("_cell").distinct().count() <= 500  # what is grown from doesn't grow with the copies


def test_edges(spark):
    d = spark.createDataFrame([(float(i % 5), float(i), 7.0) for i in range(1000)], "x double, y double, z double")
    few, many, one = forest.bin_edges(d, ["x", "y", "z"])
    assert few == [0.5, 1.5, 2.5, 3.5] and one == []
    sizes = np.diff(np.searchsorted(np.arange(1000.0), [0, *many, 1000]))
    assert len(many) == forest.BINS - 1 and sizes.min() >= 20 and sizes.max() <= 45


def test_one_tree_by_hand():
    bins = np.array([[0], [1], [2], [3]])
    weights = np.array([[5, 0], [5, 0], [0, 4], [3, 1]])
    prediction, left, right, feature, cut = forest.grow(bins, weights, 10, np.random.default_rng(0))
    assert (feature[0], cut[0]) == (0, 1)
    low, high = left[0], right[0]
    assert prediction[low] == 0 and left[low] == -1
    assert (feature[high], cut[high]) == (0, 2) and prediction[left[high]] == 1 and prediction[right[high]] == 0.25
    # both children would predict class 0: one leaf
    assert list(forest.grow(bins[:2], np.array([[9, 1], [9, 3]]), 10, np.random.default_rng(0))[0]) == pytest.approx([4 / 22])


def test_too_many_cells_are_grown_from_rows(spark, monkeypatch):
    monkeypatch.setattr(ML, "CELLS", 100)
    model = ML.train_random_forest(planted(spark, 300), FEATURES, num_trees=3, max_depth=3)
    assert not isinstance(model, forest.CellForest)
    assert ML.score(model, planted(spark, 300)).count() == 300
