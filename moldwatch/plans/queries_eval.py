"""Registered queries: splits, samples, metrics and profiling
(steps 6-7: F4-F8, F10, U1, U2, U5, A5-A8, A12-A22, A25, A28)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.asof import MINUTE_US, asof_label
from moldwatch.operators.evaluate import (best_threshold, class_weight, confusion,
                                          estimated_precision, label_balance, pr_curve,
                                          precision_buckets, roc_auc)
from moldwatch.operators.profile import (drift_report, kept_summary, machine_overlap,
                                         probability_distribution, sampling_step,
                                         scrap_rate_gate, source_coverage, status_breakdown,
                                         with_source_file)
from moldwatch.operators.rolling import rolling_time_long
from moldwatch.operators.sampling import (dedup_keep, stratified_downsample, stratified_split,
                                          structured_sample, temporal_split, union_all)
from moldwatch.plans import fixtures as fx
from moldwatch.plans import oracle as O
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.sources.tables import lineitem_events, production_log_raw, read_table

SENSORS = config.FIXTURE_SENSORS


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _r9(c, name=None):
    return F.round(c, 9).alias(name or c)


def _scored_xy(spark, sf):
    return fx.scored(spark, sf).select(F.col("scrap_probability").alias("score"),
                                       F.col("is_scrap_actual").alias("label"), "event_id",
                                       "machine_id", "timestamp")


_SC = """
sc AS (SELECT scrap_probability AS score,
              CAST(sum(CASE WHEN is_scrap_actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(sum(CASE WHEN is_scrap_actual <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
       FROM scored WHERE scrap_probability IS NOT NULL GROUP BY 1)"""
_PR = _SC + """,
cum AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
               CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
               (SELECT sum(pos) FROM sc) AS P FROM sc),
pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision,
              CASE WHEN P > 0 THEN tp / P ELSE 0.0E0 END AS recall, tp, fp
       FROM cum WHERE score >= (SELECT max(score) FROM cum WHERE tp = P)),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                       ELSE 0.0E0 END AS f1 FROM pr),
stopt AS (SELECT min(threshold) AS s FROM prf WHERE precision >= 0.85),
cand AS (SELECT * FROM prf WHERE (SELECT s FROM stopt) IS NULL OR threshold <= (SELECT s FROM stopt))"""


# --- A19: exact ROC-AUC from per-score counts ---------------------------------
@register("roc_auc", fixture_sql("""
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * nb + 0.5 * pos * neg) / (sum(pos) * sum(neg)) ELSE 0 END, 9) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM sc) t""", _SC))
def q_roc_auc(spark, sf):
    a = roc_auc(_scored_xy(spark, sf))
    return a.select(_r9("auc"), "n_pos", "n_neg")


# --- A20: PR curve ---------------------------------------------------------------
@register("pr_curve", fixture_sql("""
SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp, fp
FROM prf""", _PR))
def q_pr_curve(spark, sf):
    p = pr_curve(_scored_xy(spark, sf))
    return p.select("threshold", _r9("precision"), _r9("recall"), _r9("f1"), "tp", "fp")


# --- A20: best-F1 threshold with the precision stop, recommended levels -------
@register("pr_curve_threshold", fixture_sql("""
SELECT round(best_f1, 9) AS best_f1, best_threshold,
       round_even(best_threshold * 0.4, 2) AS low_threshold, round_even(best_threshold * 0.7, 2) AS medium_threshold,
       round_even(best_threshold * 1.0, 2) AS high_threshold
FROM (SELECT max(f1) AS best_f1,
             (SELECT threshold FROM cand ORDER BY f1 DESC, threshold LIMIT 1) AS best_threshold FROM cand) t""",
    _PR))
def q_best_threshold(spark, sf):
    b = best_threshold(pr_curve(_scored_xy(spark, sf)))
    return b.select(_r9("best_f1"), "best_threshold", "low_threshold", "medium_threshold",
                    "high_threshold")


# --- A21: precision buckets ------------------------------------------------------
@register("precision_buckets", fixture_sql("""
SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, bucket
FROM (SELECT *, max(b10) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (SELECT *, CAST(floor(precision * 20) * 5 AS INT) AS bucket,
                   CASE WHEN floor(precision * 20) * 5 >= 10 THEN CAST(floor(precision * 20) * 5 AS INT) ELSE 0 END AS b10
            FROM cand) a) b
WHERE bucket >= 10 AND bucket > coalesce(prev, 0)""", _PR))
def q_precision_buckets(spark, sf):
    b = precision_buckets(pr_curve(_scored_xy(spark, sf)))
    return b.select("threshold", _r9("precision"), _r9("recall"), _r9("f1"), "bucket")


# --- A18: confusion metrics at 0.5 (>=) and 0.7 (>) -------------------------------
def _conf_sql(t, op):
    p = f"scrap_probability {op} {t}"
    return f"""
SELECT CAST({t} AS DOUBLE) AS threshold,
  CAST(sum(CASE WHEN {p} AND is_scrap_actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN {p} AND is_scrap_actual <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN NOT ({p}) AND is_scrap_actual <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN NOT ({p}) AND is_scrap_actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM scored"""


@register("confusion_metrics", fixture_sql(f"""
SELECT threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1
FROM ({_conf_sql(0.5, '>=')} UNION ALL {_conf_sql(0.7, '>')}) t"""))
def q_confusion(spark, sf):
    xy = _scored_xy(spark, sf)
    c = confusion(xy, threshold=0.5).unionByName(confusion(xy, threshold=0.7, op=">"))
    return c.select("threshold", "tp", "fp", "tn", "fn", _r9("accuracy"), _r9("precision"),
                    _r9("recall"), _r9("f1"))


# --- A7 + A8: label balance and class weights -------------------------------------
@register("label_balance", fixture_sql("""
SELECT n, n_pos, n_neg, round(n_pos / n * 100, 9) AS pos_pct,
       round(n_neg / greatest(CASE WHEN n_pos = 0 THEN 1 ELSE n_pos END, 1), 9) AS imbalance_ratio,
       round(n_neg / greatest(n_pos, 1), 9) AS class_weight, round(least(n_neg / greatest(n_pos, 1), 50), 9) AS class_weight_cap50
FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN is_scrap_actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
             CAST(sum(CASE WHEN is_scrap_actual = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM scored) t"""))
def q_label_balance(spark, sf):
    xy = _scored_xy(spark, sf)
    lb = label_balance(xy)
    # one-row aggregates attached as scalar subqueries
    cw = class_weight(xy).select("class_weight").scalar()
    cw50 = class_weight(xy, cap=50).select("class_weight").scalar()
    j = lb.withColumn("class_weight", cw).withColumn("class_weight_cap50", cw50)
    return j.select("n", "n_pos", "n_neg", _r9("pos_pct"), _r9("imbalance_ratio"), _r9("class_weight"),
                    _r9("class_weight_cap50"))


# --- A13 + A14 + A22: probability distribution and per-machine precision ------
@register("machine_precision", fixture_sql("""
SELECT machine_id, count(*) AS rows, CAST(sum(is_scrap_actual) AS BIGINT) AS actual,
       CAST(sum(pred) AS BIGINT) AS predicted,
       round(CASE WHEN sum(pred) > 0 THEN least(sum(is_scrap_actual), sum(pred)) / sum(pred) END, 9) AS est_precision_naive,
       round(CASE WHEN sum(pred) > 0 THEN sum(CASE WHEN is_scrap_actual = 1 AND pred = 1 THEN 1 ELSE 0 END) / sum(pred) END, 9) AS precision,
       round(avg(scrap_probability), 9) AS mean_prob, max(scrap_probability) AS max_prob,
       CAST(sum(CASE WHEN scrap_probability > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_3,
       CAST(sum(CASE WHEN scrap_probability > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_5,
       CAST(sum(CASE WHEN scrap_probability > 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_7
FROM (SELECT *, CAST(scrap_probability >= 0.55 AS INT) AS pred FROM scored) t GROUP BY machine_id"""))
def q_machine_precision(spark, sf):
    s = fx.scored(spark, sf).withColumn("predicted_scrap",
                                        (F.col("scrap_probability") >= 0.55).cast("int"))
    e = estimated_precision(s)
    d = probability_distribution(s, keys=("machine_id",))
    j = e.join(d, "machine_id")
    return j.select("machine_id", "rows", "actual", "predicted", _r9("est_precision_naive"),
                    _r9("precision"), _r9("mean_prob"), "max_prob", "n_above_3", "n_above_5",
                    "n_above_7")


# --- A5 + A6: production log status breakdown and kept summary ----------------
@register("status_breakdown", fixture_sql("""
SELECT machine_status_code, count(scrap_quantity) AS rows, CAST(sum(scrap_quantity) AS BIGINT) AS total_scrap,
       CAST(sum(yield_quantity) AS BIGINT) AS total_yield,
       round_even(sum(scrap_quantity) / CASE WHEN sum(scrap_quantity) + sum(yield_quantity) = 0 THEN 1
                                             ELSE sum(scrap_quantity) + sum(yield_quantity) END * 100, 1) AS scrap_pct,
       (SELECT count(*) FROM prod_events) AS kept_events,
       (SELECT CAST(sum(scrap_quantity) AS BIGINT) FROM prod_events) AS kept_scrap
FROM production_log GROUP BY machine_status_code"""))
def q_status_breakdown(spark, sf):
    b = status_breakdown(production_log_raw(spark, sf))
    k = kept_summary(fx.events(spark, sf))
    j = b.withColumn("kept_events", k.select("events").scalar()) \
        .withColumn("kept_scrap", k.select("total_scrap").scalar())
    return j.select("machine_status_code", "rows", F.col("total_scrap").cast("long"),
                    F.col("total_yield").cast("long"), "scrap_pct", "kept_events",
                    F.col("kept_scrap").cast("long"))


# --- F4 + A15 + A16: temporal 80/20 split, drift and machine overlap ----------
_SPLIT = """
sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, machine_id) - 1
                           < floor(count(*) OVER () * 0.8) THEN 'TRAIN' ELSE 'TEST' END AS split
       FROM hist)"""


@register("temporal_split", fixture_sql("""
SELECT machine_id, timestamp, split FROM sp""", O.history_cte(), _SPLIT))
def q_temporal_split(spark, sf):
    s = temporal_split(fx.history(spark, sf), ["timestamp", "machine_id"])
    return s.select("machine_id", _ntz(), "split")


@register("drift_report", fixture_sql("""
SELECT sensor, round(train_mean, 9) AS train_mean, round(test_mean, 9) AS test_mean,
       round(CASE WHEN train_mean IS NOT NULL AND train_mean <> 0
                  THEN abs(test_mean - train_mean) / abs(train_mean) * 100 END, 9) AS shift_pct,
       coalesce(abs(test_mean - train_mean) / abs(train_mean) * 100 > 20 AND train_mean <> 0, false) AS shifted
FROM (SELECT sensor, avg(value) FILTER (WHERE split = 'TRAIN') AS train_mean,
             avg(value) FILTER (WHERE split = 'TEST') AS test_mean
      FROM (""" + O.unpivot_sql("sp", keys="split", var="sensor") + """) u GROUP BY sensor) t""",
    O.history_cte(), _SPLIT))
def q_drift(spark, sf):
    s = temporal_split(fx.history(spark, sf), ["timestamp", "machine_id"])
    d = drift_report(s, SENSORS)
    return d.select("sensor", _r9("train_mean"), _r9("test_mean"), _r9("shift_pct"), "shifted")


@register("machine_overlap", fixture_sql("""
SELECT machine_id, count(*) FILTER (WHERE split = 'TRAIN') AS train_rows,
       count(*) FILTER (WHERE split = 'TEST') AS test_rows FROM sp GROUP BY machine_id""",
    O.history_cte(), _SPLIT))
def q_overlap(spark, sf):
    s = temporal_split(fx.history(spark, sf), ["timestamp", "machine_id"])
    return machine_overlap(s)


# --- F5 / F7 / F8: seeded stratified split and downsamples -----------------------
def _ranked_sql(source, cols, label, key, part=()):
    """Rows with their digest rank inside (part, label) and the counts that quotas use."""
    p = "".join(f"{c}, " for c in part)
    over = f"OVER (PARTITION BY {', '.join(part)})" if part else "OVER ()"
    digest = "md5(concat_ws(':', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key) + ", '42'))"
    return f"""
SELECT {cols}, {label} AS label, row_number() OVER (PARTITION BY {p}{label} ORDER BY {digest}, {', '.join(key)}) AS rk,
       count(*) OVER (PARTITION BY {p}{label}) AS n_class, count(*) {over} AS n, sum(({label} = 1)::INT) {over} AS pos
FROM {source}"""


def _downsample_where(max_rows, min_pos):
    n_pos = f"least(pos, greatest(floor(pos * ({max_rows}.0 / n)), least(pos, {min_pos})), {max_rows})"
    return f"n <= {max_rows} OR (label = 1 AND rk <= {n_pos}) OR (label = 0 AND rk <= {max_rows} - {n_pos})"


_LINES = "(SELECT *, CAST(l_returnflag = 'R' AS INT) AS lab FROM lineitem)"
_LINE_KEY = ["l_orderkey", "l_linenumber"]


@register("stratified_split", f"""
SELECT l_orderkey, l_linenumber, label, CASE WHEN rk <= round(n_class * 0.2) THEN 'TEST' ELSE 'TRAIN' END AS split
FROM ({_ranked_sql(_LINES, 'l_orderkey, l_linenumber', 'lab', _LINE_KEY)}) t""")
def q_stratified_split(spark, sf):
    li = lineitem_events(spark, sf)
    s = stratified_split(li, "label", ["l_orderkey", "l_linenumber"])
    return s.select("l_orderkey", "l_linenumber", "label", "split")


@register("stratified_downsample", f"""
SELECT l_orderkey, l_linenumber, label FROM ({_ranked_sql(_LINES, 'l_orderkey, l_linenumber', 'lab', _LINE_KEY)}) t
WHERE {_downsample_where(20000, 1000)}""")
def q_strat_down(spark, sf):
    li = lineitem_events(spark, sf)
    s = stratified_downsample(li, "label", ["l_orderkey", "l_linenumber"], max_rows=20_000)
    return s.select("l_orderkey", "l_linenumber", "label")


MACHINE_ROWS, MACHINE_POS = 250_000, 2_000  # of a machine, as in the reference


def machine_downsample_sql(max_rows, min_pos):
    return fixture_sql(f"""
SELECT event_id, machine_id, label AS is_scrap_actual
FROM ({_ranked_sql('scored', 'event_id, machine_id', 'is_scrap_actual', ['event_id'], ['machine_id'])}) t
WHERE {_downsample_where(max_rows, min_pos)}""")


def machine_downsample(spark, sf, max_rows, min_pos):
    s = stratified_downsample(fx.scored(spark, sf), "is_scrap_actual", ["event_id"], max_rows=max_rows, min_pos=min_pos,
                              keys=("machine_id",))
    return s.select("event_id", "machine_id", "is_scrap_actual")


@register("stratified_downsample_machine", machine_downsample_sql(MACHINE_ROWS, MACHINE_POS))
def q_strat_down_m(spark, sf):
    return machine_downsample(spark, sf, MACHINE_ROWS, MACHINE_POS)


# --- F6 + J3 + U2: structured sampling of the long rolling table ---------------
def _lf_sql():
    from moldwatch.plans.queries_rolling import _w2_sql
    return f"\nlf AS ({_w2_sql()}),\nlab AS (SELECT lf.*, CAST(EXISTS (SELECT 1 FROM prod_events e " \
           "WHERE e.machine_id = lf.machine_id AND e.event_ts > lf.timestamp AND e.event_ts <= " \
           "lf.timestamp + INTERVAL 30 MINUTE) AS INT) AS early_scrap_risk FROM lf)"


def _stable_first(c):
    return f"arg_min({c}, timestamp) FILTER (WHERE {c} IS NOT NULL) AS {c}"


@register("structured_sample", fixture_sql(f"""
SELECT DISTINCT * FROM (
  SELECT * FROM lab WHERE early_scrap_risk = 1
  UNION ALL
  SELECT * FROM lab l WHERE EXISTS (SELECT 1 FROM lab r WHERE r.early_scrap_risk = 1
      AND r.machine_id = l.machine_id AND r.variable_name = l.variable_name
      AND r.timestamp BETWEEN l.timestamp - INTERVAL 30 MINUTE AND l.timestamp + INTERVAL 30 MINUTE)
  UNION ALL
  SELECT machine_id, variable_name, "window", min(timestamp) AS timestamp,
         {', '.join(_stable_first(c) for c in ('mean', 'std', 'min', 'max', 'last'))}, 0 AS early_scrap_risk
  FROM lab WHERE early_scrap_risk = 0
  GROUP BY machine_id, variable_name, "window", floor(epoch_us(timestamp) / 90000000)) u""", _lf_sql()))
def q_structured_sample(spark, sf):
    from moldwatch.plans.queries_rolling import WINDOWS
    lf = rolling_time_long(fx.clean(spark, sf), WINDOWS, min_periods=3)
    lf = lf.select("machine_id", "variable_name", "window", "timestamp",
                   *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max", "last")])
    lab = asof_label(lf, fx.events(spark, sf), tolerance_us=30 * MINUTE_US, direction="forward",
                     label="early_scrap_risk")
    s = structured_sample(lab)
    return s.select("machine_id", "variable_name", "window", _ntz(), "mean", "std", "min", "max",
                    "last", "early_scrap_risk")


# --- F10 + U1: union of per-source frames, dedup keep last per key -------------
@register("dedup_union", fixture_sql("""
SELECT machine_id, variable_name, timestamp, round(value, 9) AS value, source
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, variable_name, date_trunc('hour', timestamp)
                                   ORDER BY timestamp DESC, source DESC) AS rn
      FROM (SELECT machine_id, variable_name, timestamp, value, 'clean' AS source FROM clean
            UNION ALL
            SELECT machine_id, 'scrap_probability', timestamp, scrap_probability, 'scored' FROM scored) u) t
WHERE rn = 1"""))
def q_dedup_union(spark, sf):
    a = fx.clean(spark, sf).select("machine_id", "variable_name", "timestamp", "value",
                                   F.lit("clean").alias("source"))
    b = fx.scored(spark, sf).select("machine_id", F.lit("scrap_probability").alias("variable_name"),
                                    "timestamp", F.col("scrap_probability").alias("value"),
                                    F.lit("scored").alias("source"))
    u = union_all([a, b]).withColumn("hour", F.date_trunc("hour", "timestamp"))
    d = dedup_keep(u, ["machine_id", "variable_name", "hour"], order=["timestamp", "source"], keep="last")
    return d.select("machine_id", "variable_name", _ntz(), _r9("value"), "source")


# --- A12: median sampling step per machine -------------------------------------
@register("sampling_step", fixture_sql("""
SELECT machine_id, CAST(CASE WHEN n >= 2 AND med IS NOT NULL AND med > 0
                            THEN least(greatest(round(med), 10), 120) ELSE 60 END AS INT) AS step_seconds
FROM (SELECT machine_id, count(*) AS n, quantile_cont(d, 0.5) AS med
      FROM (SELECT machine_id, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY machine_id
                                ORDER BY timestamp))) / 1e6 AS d FROM hist) t GROUP BY machine_id) s""",
    O.history_cte()))
def q_sampling_step(spark, sf):
    return sampling_step(fx.history(spark, sf))


# --- A17: source coverage per file and machine ---------------------------------
@register("source_coverage", fixture_sql("""
SELECT 'events.parquet' AS source_file, 'M' || CAST(100 + user_id % 5 AS VARCHAR(10)) AS machine_id,
       min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows,
       CAST((SELECT count(*) FROM (DESCRIBE events)) AS INT) AS n_columns
FROM events GROUP BY 2"""))
def q_source_coverage(spark, sf):
    table = read_table(spark, sf, "events")
    scan = with_source_file(table)
    x = scan.withColumn("machine_id", F.concat(F.lit("M"), (F.lit(100) + F.col("user_id") % 5).cast("string"))) \
        .withColumn("timestamp", F.col("ts"))
    c = source_coverage(x, len(table.columns))
    return c.select("source_file", "machine_id", F.col("first_ts").cast("timestamp_ntz"),
                    F.col("last_ts").cast("timestamp_ntz"), "rows", F.col("n_columns").cast("int"))


# --- A28: scrap-rate sanity gate of the nearest-as-of labels -------------------
@register("scrap_rate_gate", fixture_sql("""
SELECT machine_id, count(*) AS rows, CAST(sum(is_scrap) AS BIGINT) AS scrap_rows,
       round(sum(is_scrap) / count(*) * 100, 9) AS scrap_pct,
       CASE WHEN sum(is_scrap) / count(*) * 100 > 10 THEN 'HIGH' WHEN sum(is_scrap) / count(*) * 100 > 5 THEN 'ELEVATED'
            WHEN sum(is_scrap) / count(*) * 100 < 0.1 THEN 'LOW' ELSE 'OK' END AS verdict
FROM (SELECT c.machine_id, CASE WHEN EXISTS (SELECT 1 FROM prod_events e WHERE e.machine_id = c.machine_id
          AND e.event_ts BETWEEN c.timestamp - INTERVAL 5 MINUTE AND c.timestamp + INTERVAL 5 MINUTE)
          THEN 1 ELSE 0 END AS is_scrap FROM clean c) t GROUP BY machine_id"""))
def q_scrap_gate(spark, sf):
    lab = asof_label(fx.clean(spark, sf), fx.events(spark, sf), label="is_scrap")
    g = scrap_rate_gate(lab, keys=("machine_id",))
    return g.select("machine_id", "rows", "scrap_rows", _r9("scrap_pct"), "verdict")


# --- A25: past scrap / high-risk counts per machine -----------------------------
@register("summary_stats", fixture_sql("""
SELECT machine_id, CAST(sum(CASE WHEN coalesce(is_scrap_actual, 0) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS past_scrap_detected,
       CAST(sum(CASE WHEN scrap_probability >= 0.55 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_points,
       count(*) AS total_rows
FROM hist GROUP BY machine_id""", O.history_cte()))
def q_summary_stats(spark, sf):
    h = fx.history(spark, sf)
    return h.groupBy("machine_id").agg(
        F.sum((F.coalesce("is_scrap_actual", F.lit(0)) >= 1).cast("long")).alias("past_scrap_detected"),
        F.sum((F.col("scrap_probability") >= 0.55).cast("long")).alias("high_risk_points"),
        F.count(F.lit(1)).alias("total_rows"))

