"""Model training and scoring with Spark ML (ML1-ML7, A23, A24, J10).

Gradient-boosted trees replace the leaf-wise booster (no leaf-wise growth,
no L1/L2); boosting waits for the validation AUC as each preset says, and the
class weight enters as ``weightCol``.  Everything here is distributed Spark ML; the only
driver-side values are model parameters (coefficients, importances), whose
size is bounded by the number of features.
"""
from __future__ import annotations

import hashlib
import math
import uuid
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.ml import boost
from moldwatch.ml.forest import CELLS, CellForest, bin_edges, fit_cells
from moldwatch.ml.trees import boost_with_patience
from moldwatch.session import checkpoint_dir


def gbt_params(preset: str) -> dict:
    """Spark ML settings of a boosting preset (ML1).  Spark grows trees level by level: a
    preset's leaf count becomes the depth that can hold it; L1 / L2 have no counterpart."""
    rounds, rate, leaves, smallest, _, _ = config.BOOSTING_PRESETS[preset]
    return dict(maxIter=rounds, stepSize=rate, maxDepth=(leaves - 1).bit_length(), minInstancesPerNode=smallest,
                subsamplingRate=config.BOOSTING_SHARE, featureSubsetStrategy=str(config.BOOSTING_SHARE))


def weight_cap(preset: str) -> float | None:
    """Largest class weight of a boosting preset (None: no cap)."""
    return config.BOOSTING_PRESETS[preset][4]


def leakage_free(columns, prefixes, mode: str = "exact_or_block") -> list[str]:
    """Feature names without leaking counters (P12): ``exact_or_block`` drops
    ``p`` and ``p__*``; ``prefix`` drops every name starting with ``p``."""
    out = []
    for c in columns:
        if mode == "prefix":
            bad = any(c.startswith(p) for p in prefixes)
        else:
            bad = any(c == p or c.startswith(p + "__") for p in prefixes)
        if not bad:
            out.append(c)
    return out


def with_class_weight(df: DataFrame, label: str, weight: float, col: str = "weight") -> DataFrame:
    """Positive rows weighted by the class weight (A8), negatives 1."""
    return df.withColumn(col, F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def filled(df: DataFrame, features) -> DataFrame:
    """NULL and NaN features as 0, as the served models take them."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})


def train_gbt(train: DataFrame, features, label: str = "label", weight_col: str | None = "weight",
              validation_col: str | None = None, preset: str = "retrain_v2", seed: int = 42,
              **overrides) -> PipelineModel:
    """Class-weighted boosted trees (ML1); missing features count as 0.  With a validation
    column its rows are held out: boosting ends once the preset's number of rounds to wait has
    brought no better AUC on them, and the model keeps the trees up to the best round
    (all rounds if the held-out rows lack a label).  Trees are grown by ``boost``; by Spark ML where its tasks
    can't work together, for other settings than the presets' and for very wide tables."""
    params = gbt_params(preset) | overrides
    rounds, patience = params["maxIter"], config.BOOSTING_PRESETS[preset][5]
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    train = filled(train, features).withColumn(label, F.col(label).cast("double"))

    def learner(n):
        gbt = GBTClassifier(featuresCol="_features", labelCol=label, seed=seed, **(params | {"maxIter": n}))
        return gbt.setWeightCol(weight_col) if weight_col else gbt

    def fit(df, n):
        return learner(n).fit(df)

    if set(params) == set(gbt_params(preset)) and len(features) <= boost.WIDEST:
        settings = boost.Settings(rounds, params["stepSize"], params["maxDepth"], params["minInstancesPerNode"], params["subsamplingRate"],
                                  math.ceil(float(params["featureSubsetStrategy"]) * len(features)), True, patience if validation_col else 0, seed)
        try:
            edges, (trees,), _ = boost.fit_trees(train.sparkSession, train, features, [label], settings, weight_col, validation_col)
            return PipelineModel([asm, boost.spark_model(train.sparkSession, learner(rounds), GBTClassificationModel, trees, edges,
                                                         settings.rate)])
        except boost.NoCommonFolder:
            pass

    if not validation_col:
        return PipelineModel([asm, fit(asm.transform(train), rounds)])
    held_out = F.coalesce(F.col(validation_col), F.lit(False))
    own = asm.transform(train.where(~held_out)).persist()
    try:
        model, _ = boost_with_patience(fit, own, train.where(held_out), features, label, rounds, patience)
    finally:
        own.unpersist()
    return PipelineModel([asm, model])


def train_random_forest(train: DataFrame, features, label: str = "label", num_trees: int = 200,
                        max_depth: int = 10, seed: int = 42) -> PipelineModel | CellForest:
    """Random forest (ML2): grown from counted cells where the features' bins make at most ``CELLS`` of
    them (see ``forest``), else by Spark ML from the rows."""
    if len(features) <= CELLS.bit_length():
        rows = filled(train, features)
        edges = bin_edges(rows, features)
        if math.prod(len(e) + 1 for e in edges) <= CELLS:
            return fit_cells(rows, features, label, edges, num_trees, max_depth, seed)
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed)
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[asm, rf]).fit(filled(train, features).withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel | CellForest, df: DataFrame, threshold: float = 0.5,
          prob_col: str = "scrap_probability", pred_col: str = "predicted_scrap") -> DataFrame:
    """Batch scoring (ML3): class-1 probability and the thresholded label."""
    features = model.features if isinstance(model, CellForest) else model.stages[0].getInputCols()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *features)
    if isinstance(model, CellForest):
        return model.transform(filled(rows, features), prob_col).select(
            "_row.*", prob_col, (F.col(prob_col) >= threshold).cast("int").alias(pred_col))
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(filled(rows, features)).select("_row.*", p.alias(prob_col), (p >= threshold).cast("int").alias(pred_col))


def score_missing(model, history: DataFrame, prob_col: str = "scrap_probability") -> DataFrame:
    """``history`` with a probability in every row (ML3): rows that have one keep it, only those without
    (NULL or NaN) are scored; all are held within 0 and 1.  ``model``: a fitted pipeline, or a
    function that adds ``prob_col`` to rows without it."""
    known = F.coalesce(F.col(prob_col).isNotNull() & ~F.isnan(F.col(prob_col)), F.lit(False))
    lacking = history.where(~known).drop(prob_col)
    made = model(lacking) if callable(model) else score(model, lacking, prob_col=prob_col, pred_col="_pred")
    p = F.coalesce(F.col(prob_col), F.lit(0.0))
    return history.where(known).unionByName(made.select(*history.columns)).withColumn(
        prob_col, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def importances(spark: SparkSession, model: PipelineModel, features) -> DataFrame:
    """(feature, importance, rank) sorted by importance (ML4, J10).

    Names and values are zipped with a length check; the vector has one
    entry per feature (bounded by the feature count)."""
    vec = model.stages[-1].featureImportances.toArray().tolist()
    if len(vec) != len(features):
        raise ValueError("feature names and importances differ in length")
    df = spark.createDataFrame(list(zip(list(features), [float(v) for v in vec])),
                               "feature string, importance double")
    # one row per feature: a global order over a feature-sized table
    return df.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("importance").desc(), "feature")))


def importance_by_parameter(imp: DataFrame, top: int = 5) -> DataFrame:
    """Importance summed per parameter (name before '__'), top k."""
    return (imp.groupBy(F.split("feature", "__")[0].alias("parameter"))
            .agg(F.sum("importance").alias("importance"))
            .orderBy(F.col("importance").desc(), "parameter").limit(top))


def leakage_audit(imp: DataFrame, needles=("counter", "Counter")) -> DataFrame:
    """Importance rows whose feature name contains a counter."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.col("feature").contains(n)
    return imp.where(cond)


def fit_linear_forecaster(lagged: DataFrame, sensors, lags: int, extra=()) -> tuple[dict, dict]:
    """One-step multi-output forecaster (ML6): one LinearRegression per
    target sensor on [extra] + current + lags 1..k of every sensor; returns
    (coef[target][feature], intercept[target]) -- small, per feature."""
    feats = list(extra) + list(sensors) + [f"{s}_lag_{i}" for i in range(1, lags + 1) for s in sensors]
    x = lagged
    for s in sensors:
        for i in range(1, lags + 1):
            if f"{s}_lag{i}" in x.columns:
                x = x.withColumnRenamed(f"{s}_lag{i}", f"{s}_lag_{i}")
    asm = VectorAssembler(inputCols=feats, outputCol="_f", handleInvalid="skip")
    data = asm.transform(x).cache()
    coef, icpt = {}, {}
    try:
        for s in sensors:
            m = LinearRegression(featuresCol="_f", labelCol=f"{s}_next", regParam=0.0).fit(data)
            coef[s] = dict(zip(feats, [float(v) for v in m.coefficients.toArray()]))
            icpt[s] = float(m.intercept)
    finally:
        data.unpersist()
    return coef, icpt


def fit_tree_forecaster(lagged: DataFrame, sensors, preset: str, extra=(), seed: int = 42) -> dict[str, PipelineModel]:
    """One-step multi-output forecaster of boosted trees (ML6): per target sensor a model on
    [extra] + current + lags 1..k of every sensor (columns ``{s}_lag{i}``, target
    ``{s}_next``; see ``lag_features``), trees, rate, depth and k from the preset.  The sensors' models
    don't depend on each other and grow side by side, by ``boost`` or, where its tasks can't work together, by Spark ML."""
    trees, rate, depth, _ = config.FORECASTER_PRESETS[preset]
    feats = forecaster_features(sensors, preset, extra)
    asm = VectorAssembler(inputCols=feats, outputCol="_f", handleInvalid="skip")

    def learner(s):
        return GBTRegressor(featuresCol="_f", labelCol=f"{s}_next", predictionCol=f"{s}_forecast", maxIter=trees, stepSize=rate,
                            maxDepth=depth, seed=seed)

    if len(feats) <= boost.WIDEST:
        whole = F.lit(True)  # rows that the assembler doesn't skip
        for c in feats:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        spark = lagged.sparkSession
        try:
            edges, grown, _ = boost.fit_trees(spark, lagged.where(whole), feats, [f"{s}_next" for s in sensors],
                                              boost.Settings(trees, rate, depth, seed=seed))

            def built(s, own):
                return s, PipelineModel([asm, boost.spark_model(spark, learner(s), GBTRegressionModel, own, edges, rate)])

            with ThreadPool(max(1, len(sensors))) as pool:
                return dict(pool.starmap(inheritable_thread_target(spark)(built), list(zip(sensors, grown))))
        except boost.NoCommonFolder:
            pass
    data = asm.transform(lagged).persist()

    def fit(s):
        return s, PipelineModel([asm, learner(s).fit(data.where(F.col(f"{s}_next").isNotNull()))])

    try:
        with ThreadPool(max(1, len(sensors))) as pool:
            return dict(pool.map(inheritable_thread_target(lagged.sparkSession)(fit), list(sensors)))
    finally:
        data.unpersist()


def forecaster_features(sensors, preset: str, extra=()) -> list[str]:
    """The inputs of a preset's tree forecaster, in order."""
    lags = config.FORECASTER_PRESETS[preset][3]
    return list(extra) + list(sensors) + [f"{s}_lag{i}" for i in range(1, lags + 1) for s in sensors]


def forecast_one_step(models: dict[str, PipelineModel], lagged: DataFrame) -> DataFrame:
    """``lagged`` with a ``{sensor}_forecast`` column for every model."""
    for m in models.values():
        lagged = m.transform(lagged).drop("_f")
    return lagged


def metrics_record(spark: SparkSession, version: str, metrics: DataFrame, extra: dict) -> DataFrame:
    """One-row model version record (ML7): metrics row + parameters."""
    row = metrics
    for k, v in extra.items():
        row = row.withColumn(k, F.lit(v))
    return row.withColumn("model_version", F.lit(version)).withColumn(
        "created_at", F.current_timestamp())


def rows_digest(data: DataFrame) -> tuple:
    """(rows, sum of their hashes)."""
    return tuple(data.select(F.xxhash64(*data.columns).alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first())


def fitted_once(spark: SparkSession, name: str, data: DataFrame, settings, fit, rows: tuple | None = None) -> PipelineModel:
    """``fit()``, or what an earlier run fitted to the same rows with the same settings: models are kept below
    the shared folder under a digest of both.  ``rows``: the data's digest, where many models share it."""
    rows = rows or rows_digest(data)
    digest = hashlib.md5(f"{rows} {data.dtypes} {settings}".encode()).hexdigest()
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{name}-{digest}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        own = f"{path}-{uuid.uuid4().hex}"  # seen by others only when whole
        model = fit()
        model.write().save(own)
        if fs.rename(hadoop(own), hadoop(path)):
            return model
        fs.delete(hadoop(own), True)
    return PipelineModel.load(path)


def class_weight_value(train: DataFrame, label: str, cap: float | None = None) -> float:
    """The class weight as a number for the learner (A8); one aggregate row."""
    r = train.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"),
                  F.sum((F.col(label) != 1).cast("long")).alias("n")).first()
    w = (r["n"] or 0) / max(r["p"] or 0, 1)
    return min(w, cap) if cap is not None else w


def fitted_forecaster(spark: SparkSession, lagged: DataFrame, sensors, preset: str) -> dict[str, PipelineModel]:
    """:func:`fit_tree_forecaster`, kept as in :func:`fitted_once`."""
    fitted: dict[str, PipelineModel] = {}
    rows, own = rows_digest(lagged), Lock()

    def fit(s):
        with own:
            if not fitted:
                fitted.update(fit_tree_forecaster(lagged, sensors, preset))
        return fitted[s]

    def kept(s):
        return s, fitted_once(spark, f"forecast-{s}", lagged, (list(sensors), preset, config.FORECASTER_PRESETS[preset]), lambda: fit(s), rows)

    with ThreadPool(max(1, len(sensors))) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(kept), list(sensors)))
