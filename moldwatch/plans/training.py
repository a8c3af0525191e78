"""Training-set construction and model workflow over all machines at once:
clean -> forward label -> long rolling -> one pivot -> pattern features ->
machine context encodings -> leakage-free, conformed feature matrix ->
temporal split -> class-weighted boosted trees -> scores and metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.ml import models as ML
from moldwatch.operators.asof import MINUTE_US, asof_label
from moldwatch.operators.encode import apply_encoding, encode_with_map, fit_label_encoding, machine_context
from moldwatch.operators.latest import max_label
from moldwatch.operators.pattern import pattern_features
from moldwatch.operators.rolling import STATS, long_to_wide_features, rolling_time_long
from moldwatch.operators.sampling import conform, stratified_split, temporal_split
from moldwatch.plans import fixtures as fx
from moldwatch.functions import normalize_machine_id
from moldwatch.session import ensure_wide_rows, materialize, stored
from moldwatch.sources.tables import telemetry_raw

SENSORS = config.FIXTURE_SENSORS
WINDOWS = config.FIXTURE_WINDOWS
LABEL = "early_scrap_risk"


def feature_columns(sensors=SENSORS, windows=WINDOWS, pattern_source="mean_1d"):
    cols = [f"{s}__{st}_{w}" for s in sensors for w, _ in windows for st in STATS]
    cols += [f"{s}__{k}_10" for s in sensors for k in ("pstd", "pmean", "ptrend", "pdev")]
    cols += ["tool_id_encoded", "part_number_encoded", "machine_id_encoded"]
    return ML.leakage_free(cols, config.LEAKAGE_PREFIXES)


def packed(df: DataFrame, columns, out: str = "_cells", keep=()) -> DataFrame:
    """``df`` with ``columns`` as one array (:func:`unpacked` takes them out again; those of ``keep`` stay beside it): dozens of
    columns cost more than their values wherever rows are read, joined, sorted or handed to Python."""
    rest = [c for c in df.columns if c not in columns or c in keep]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def unpacked(df: DataFrame, columns, out: str = "_cells") -> DataFrame:
    rest = [c for c in df.columns if c != out and c not in columns]
    return df.select(*rest, *[F.col(out)[i].alias(c) for i, c in enumerate(columns)])


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    ensure_wide_rows(spark)
    clean = fx.clean(spark, sf)
    long = rolling_time_long(clean, WINDOWS, min_periods=3)
    wide = long_to_wide_features(long, SENSORS, WINDOWS)
    lab = asof_label(clean, fx.events(spark, sf), tolerance_us=30 * MINUTE_US, direction="forward",
                     label=LABEL)
    labels = max_label(lab, label=LABEL)
    wide = wide.join(labels, ["machine_id", "timestamp"], "left").withColumn(
        LABEL, F.coalesce(F.col(LABEL), F.lit(0)).cast("int"))
    cells = [f"{s}__{st}_{w}" for s in SENSORS for w, _ in WINDOWS for st in STATS]
    wide = stored(packed(wide, cells, keep=[f"{s}__mean_1d" for s in SENSORS]), "wide")  # numbering its rows and the features both read it
    wide = unpacked(pattern_features(wide, SENSORS, source="mean_1d"), cells)
    raw = telemetry_raw(spark, sf).withColumn("machine_id", normalize_machine_id("machine_id"))
    ctx = machine_context(raw)
    ctx = encode_with_map(ctx, "tool_id", config.ENCODINGS["tool_id"])
    ctx = encode_with_map(ctx, "part_number", config.ENCODINGS["part_number"])
    ctx = apply_encoding(ctx, fit_label_encoding(ctx, "machine_id"), "machine_id", broadcast_dim=False)
    wide = wide.join(ctx.select("machine_id", "tool_id_encoded", "part_number_encoded",
                                "machine_id_encoded"), "machine_id", "left")
    feats = feature_columns()
    return conform(wide, ["machine_id", "timestamp", LABEL] + feats, fill=None).select(
        "machine_id", "timestamp", F.col(LABEL).cast("int").alias(LABEL),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])


_TABLE_CACHE: dict = {}


def packed_table(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`training_table` with its features packed, computed once per input: the split reads it three times, queries on
    its latest rows twice more."""
    key = (sf, id(spark))
    if key not in _TABLE_CACHE:
        _TABLE_CACHE[key] = stored(packed(training_table(spark, sf), feature_columns()), "training")
    return _TABLE_CACHE[key]


def kept_table(spark: SparkSession, sf: str) -> DataFrame:
    return unpacked(packed_table(spark, sf), feature_columns())


_MODEL_CACHE: dict = {}


def clear_caches() -> None:
    """Forget the models (and what other modules keep of them): the next query trains anew."""
    from moldwatch.plans import queries_forecast, queries_live, queries_room
    for c in (_TABLE_CACHE, _MODEL_CACHE, _RAW_MODEL_CACHE, queries_forecast._FILLED_CACHE, queries_live._STATUS_CACHE, queries_room._CACHE):
        c.clear()


def trained(spark: SparkSession, sf: str, preset: str = "retrain_v2"):
    """(model, scored test rows, features); the model is cached per input so
    the queries that share it train once."""
    key = (sf, preset, id(spark))
    if key in _MODEL_CACHE:
        return _MODEL_CACHE[key]
    table = stored(temporal_split(packed_table(spark, sf), ["timestamp", "machine_id"]), "split")
    feats = feature_columns()
    train = table.where(F.col("split") == "TRAIN")
    test = unpacked(table.where(F.col("split") == "TEST"), feats)
    cw = ML.class_weight_value(train, LABEL, cap=ML.weight_cap(preset))
    # validation = the last 20 % of the training period (chronological)
    tr = temporal_split(train.drop("split"), ["timestamp", "machine_id"], 0.8, out="_role") \
        .withColumn("_is_val", F.col("_role") == "TEST").drop("_role")
    tr = ML.with_class_weight(unpacked(tr, feats), LABEL, cw)
    model = ML.fitted_once(spark, "training", tr, (feats, preset, ML.gbt_params(preset), config.BOOSTING_PRESETS[preset]),
                           lambda: ML.train_gbt(tr, feats, LABEL, weight_col="weight", validation_col="_is_val", preset=preset),
                           rows=ML.rows_digest(train))  # role and weight follow from the rows
    scored = ML.score(model, test, threshold=config.ML_THRESHOLDS["MEDIUM"]).select(
        "machine_id", "timestamp", LABEL, "scrap_probability", "predicted_scrap")
    scored = stored(scored, "scored")  # every metric reads it
    _MODEL_CACHE[key] = (model, scored, feats, cw)
    return _MODEL_CACHE[key]


_RAW_MODEL_CACHE: dict = {}


def raw_sensor_model(spark: SparkSession, sf: str):
    """The served model: boosted trees on filled raw sensor rows labelled by
    the nearest as-of join (the raw-sensor training path), a stratified fifth held out to
    choose the number of rounds."""
    from moldwatch.operators.rolling import fill_forward_backward
    from moldwatch.plans.queries_join import wide
    key = (sf, id(spark))
    if key not in _RAW_MODEL_CACHE:
        preset = "retrain_v2"
        w = fill_forward_backward(wide(spark, sf), SENSORS)
        lab = asof_label(w, fx.events(spark, sf), label="label").select("machine_id", "timestamp", *SENSORS, "label")
        lab = materialize(stratified_split(lab, "label", ["machine_id", "timestamp"]))
        cw = ML.class_weight_value(lab.where(F.col("split") == "TRAIN"), "label", cap=ML.weight_cap(preset))
        lab = ML.with_class_weight(lab.withColumn("_held", F.col("split") == "TEST"), "label", cw)
        _RAW_MODEL_CACHE[key] = ML.fitted_once(
            spark, "raw", lab, (SENSORS, preset, ML.gbt_params(preset), config.BOOSTING_PRESETS[preset]),
            lambda: ML.train_gbt(lab, SENSORS, "label", validation_col="_held", preset=preset))
    return _RAW_MODEL_CACHE[key]
