"""Registered queries: training table, model scores, metrics, importances,
explanations and future risk (step 9: ML1-ML7, A23, A24, J10, M5).
Model outputs are checked by rows only (tree learners differ by engine)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import clip_probability, is_idle
from moldwatch.ml import models as ML
from moldwatch.operators.evaluate import best_threshold, confusion, pr_curve, roc_auc
from moldwatch.operators.latest import latest_row
from moldwatch.operators.sampling import temporal_split
from moldwatch.plans import fixtures as fx
from moldwatch.plans import oracle as O
from moldwatch.plans import training as T
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.sources.tables import LINEITEM_FEATURES, lineitem_events


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _training_sql(n=10):
    """The training table: rolling features, forward label, patterns of the daily mean, encodings."""
    from moldwatch.plans.queries_rolling import _w2_sql
    wide = [f"max({st}) FILTER (WHERE variable_name = '{s}' AND \"window\" = '{w}') AS {s}__{st}_{w}"
            for s in T.SENSORS for w, _ in T.WINDOWS for st in ("mean", "std", "min", "max", "last")]
    over = "OVER (PARTITION BY machine_id ORDER BY timestamp"
    frame = f"{over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    ranks = [f"CAST(count({s}__mean_1d) {over} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS k_{s}" for s in T.SENSORS]
    pattern = []
    for s in T.SENSORS:
        y, ok = f"{s}__mean_1d", f"count({s}__mean_1d) {frame} >= 3"
        mean = f"CASE WHEN {ok} THEN avg({y}) {frame} END"
        pattern += [f"CASE WHEN {ok} THEN stddev_samp({y}) {frame} END AS {s}__pstd_{n}", f"{mean} AS {s}__pmean_{n}",
                    f"CASE WHEN {ok} THEN regr_slope({y}, k_{s}) {frame} END AS {s}__ptrend_{n}",
                    f"({y} - {mean}) / (abs({mean}) + 1e-6) AS {s}__pdev_{n}"]
    codes = {c: ", ".join(f"('{v}', {code})" for v, code in config.ENCODINGS[c]) for c in ("tool_id", "part_number")}
    feats = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 9) AS {c}" for c in T.feature_columns())
    return (f"SELECT machine_id, timestamp, {T.LABEL}, {feats} FROM tp JOIN tc USING (machine_id)", f"""
lf AS ({_w2_sql(rounded=False)}),
tw AS (SELECT machine_id, timestamp, {", ".join(wide)} FROM lf GROUP BY machine_id, timestamp),
tl AS (SELECT tw.*, CAST(EXISTS (SELECT 1 FROM prod_events e WHERE e.machine_id = tw.machine_id AND e.event_ts > tw.timestamp
    AND e.event_ts <= tw.timestamp + INTERVAL 30 MINUTE) AS INT) AS {T.LABEL}, {", ".join(ranks)} FROM tw),
tp AS (SELECT *, {", ".join(pattern)} FROM tl),
td AS (SELECT CASE WHEN starts_with(c, 'M') THEN c ELSE 'M' || c END AS machine_id, arg_min(machine_definition, timestamp) AS definition
    FROM (SELECT *, upper(regexp_replace(coalesce(machine_id, ''), '[^A-Za-z0-9]', '', 'g')) AS c FROM telemetry) GROUP BY 1),
tc AS (SELECT machine_id, dense_rank() OVER (ORDER BY machine_id) - 1 AS machine_id_encoded, coalesce(t.code, 0) AS tool_id_encoded,
    coalesce(p.code, 0) AS part_number_encoded FROM td
    LEFT JOIN (SELECT * FROM (VALUES {codes["tool_id"]}) AS v(value, code)) t ON t.value = regexp_extract(definition, '-([A-Za-z0-9]+)$', 1)
    LEFT JOIN (SELECT * FROM (VALUES {codes["part_number"]}) AS v(value, code)) p ON p.value = 'UNKNOWN')""")


@register("training_features", fixture_sql(*_training_sql()))
def q_training_features(spark, sf):
    t = T.training_table(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return t.select("machine_id", "timestamp", T.LABEL, *[F.round(c, 9).alias(c) for c in T.feature_columns()])


@register("model_scores")
def q_model_scores(spark, sf):
    _, scored, _, _ = T.trained(spark, sf)
    return scored.select("machine_id", _ntz(), T.LABEL, "scrap_probability", "predicted_scrap")


def _xy(scored):
    return scored.select(F.col("scrap_probability").alias("score"), F.col(T.LABEL).alias("label"))


@register("model_metrics")
def q_model_metrics(spark, sf):
    model, scored, feats, cw = T.trained(spark, sf)
    xy = _xy(scored)
    m = confusion(xy, threshold=0.5)
    auc = roc_auc(xy)
    best = best_threshold(pr_curve(xy))
    # one-row metric tables attached as scalar subqueries
    m = m.withColumn("auc", auc.select("auc").scalar())
    for c in ("best_f1", "best_threshold", "low_threshold", "medium_threshold", "high_threshold"):
        m = m.withColumn(c, best.select(c).scalar())
    return ML.metrics_record(spark, "gbt-" + T.LABEL, m,
                             {"n_features": len(feats), "class_weight": float(cw),
                              "kept_rounds": model.stages[-1].getNumTrees}).drop("created_at")


@register("feature_importance")
def q_importance(spark, sf):
    model, _, feats, _ = T.trained(spark, sf)
    imp = ML.importances(spark, model, feats)
    by_param = ML.importance_by_parameter(imp, top=5).withColumn("kind", F.lit("parameter")) \
        .withColumnRenamed("parameter", "feature").withColumn("rank", F.lit(None).cast("int"))
    audit = ML.leakage_audit(imp).withColumn("kind", F.lit("leak"))
    return imp.withColumn("kind", F.lit("feature")).unionByName(by_param).unionByName(audit)


@register("explain_latest")
def q_explain(spark, sf):
    """ML5: score of each machine's latest row + the top global importances."""
    model, _, feats, _ = T.trained(spark, sf)
    last = latest_row(T.kept_table(spark, sf))
    s = ML.score(model, last)
    imp = ML.importances(spark, model, feats).where(F.col("rank") <= 10)
    top = imp.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))),
                                           lambda e: e["feature"]), ",").alias("top_features"))
    return s.select("machine_id", _ntz(), "scrap_probability").withColumn("top_features", top.scalar())


@register("random_forest_scores")
def q_random_forest(spark, sf):
    """ML2: 200-tree depth-10 forest, 70/30 chronological split, counters dropped."""
    li = temporal_split(lineitem_events(spark, sf), ["l_shipdate", "l_orderkey", "l_linenumber"], 0.7)
    feats = [c for c in LINEITEM_FEATURES if "counter" not in c.lower()]
    model = ML.train_random_forest(li.where(F.col("split") == "TRAIN"), feats, "label")
    s = ML.score(model, li.where(F.col("split") == "TEST"), threshold=0.5)
    return s.select("l_orderkey", "l_linenumber", "label", "scrap_probability", "predicted_scrap")


@register("future_risk")
def q_future_risk(spark, sf):
    """M5: the recursive sensor forecast scored by the classifier: forecast
    sensors feed the rolling inputs (carried features held), probability
    clipped, idle masked, predicted = p >= .55."""
    from moldwatch.plans.queries_forecast import q_recursive
    model, _, feats, _ = T.trained(spark, sf)
    fc = q_recursive(spark, sf)
    carried = latest_row(T.kept_table(spark, sf)).drop("timestamp", T.LABEL)
    carried = carried.drop(*[f"{s}__last_6h" for s in config.FIXTURE_SENSORS])
    x = fc.join(carried, "machine_id")
    for s in config.FIXTURE_SENSORS:
        x = x.withColumn(f"{s}__last_6h", F.col(s))
    sc = ML.score(model, x.select("machine_id", "step", "timestamp", *config.FIXTURE_SENSORS,
                                  *feats))
    p = F.when(is_idle("Cycle_time"), F.lit(0.0)).otherwise(clip_probability("scrap_probability"))
    return sc.select("machine_id", "step", "timestamp", p.alias("scrap_probability"),
                     (p >= config.ML_THRESHOLDS["MEDIUM"]).cast("int").alias("predicted_scrap"))


# --- ML3: history of which some rows already carry a probability -------------
RULE = ("Injection_pressure", 250.0, 0.25, 0.75)  # a fixed stump for the SQL twin: p is one of two values


def _lacking(spark, sf):
    """The scored history without the probabilities of odd minutes; one in 30 minutes holds NaN."""
    h = fx.history(spark, sf).select("machine_id", "timestamp", *config.FIXTURE_SENSORS, "scrap_probability")
    m = F.minute("timestamp")
    return h.withColumn("scrap_probability", F.when(m % 30 == 0, F.lit(float("nan"))).when(m % 2 == 0, F.col("scrap_probability")))


@register("score_missing", fixture_sql(f"""
SELECT machine_id, timestamp, round(CASE WHEN minute(timestamp) % 2 = 0 AND minute(timestamp) % 30 <> 0 THEN scrap_probability
    WHEN coalesce({RULE[0]}, 0) <= {RULE[1]} THEN {RULE[2]}E0 ELSE {RULE[3]}E0 END, 9) AS scrap_probability FROM hist""", O.history_cte()))
def q_score_missing(spark, sf):
    """ML3: only rows without a probability are scored, here by a fixed rule."""
    h = ML.score_missing(lambda rows: rows.withColumn("scrap_probability", F.when(
        F.coalesce(F.col(RULE[0]), F.lit(0.0)) <= RULE[1], RULE[2]).otherwise(RULE[3])), _lacking(spark, sf))
    return h.select("machine_id", _ntz(), F.round("scrap_probability", 9).alias("scrap_probability"))


@register("score_missing_model")
def q_score_missing_model(spark, sf):
    """ML3 with the served model."""
    h = ML.score_missing(T.raw_sensor_model(spark, sf), _lacking(spark, sf))
    return h.select("machine_id", _ntz(), "scrap_probability")
