"""Registered queries: limits, root causes, alerts, status grid, windows
and downsampling (step 5: A9, A10, D2-D12, D18, J9, P13-P19, F2, F3, F9, F11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import finite_or_null, round_half_even
from moldwatch.operators.alerts import (adjusted_risk, alert_level, breach_severity_ui,
                                        first_abnormal, rca_table, risk_status, status_grid)
from moldwatch.operators.ingest import recent_window
from moldwatch.operators.latest import latest_values
from moldwatch.operators.limits import merge_limits, percentile_limits, violations
from moldwatch.operators.sampling import downsample_stride, recent_tail, stride_every
from moldwatch.plans import fixtures as fx
from moldwatch.plans import oracle as O
from moldwatch.plans.catalog import register
from moldwatch.plans.monitor import current_state, filled_window, machine_health, unpivot, window_limits
from moldwatch.plans.oracle import fixture_sql

SENSORS = config.FIXTURE_SENSORS
WINDOW_MIN = 3 * 24 * 60  # fixture past window (sparse data), parameter


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _r9(c, name=None):
    return F.round(c, 9).alias(name or (c if isinstance(c, str) else None))


def _filled(spark, sf):
    return filled_window(fx.history(spark, sf), SENSORS, WINDOW_MIN)


# --- A9: percentile safe limits from low-risk rows ----------------------------
@register("percentile_limits", fixture_sql("""
SELECT variable_name AS sensor, round_even(quantile_cont(value, 0.01), 2) AS min_limit,
       round_even(quantile_cont(value, 0.99), 2) AS max_limit
FROM clean c JOIN scored s USING (event_id) WHERE s.scrap_probability < 0.30
GROUP BY variable_name"""))
def q_percentile_limits(spark, sf):
    c = fx.clean(spark, sf).join(fx.scored(spark, sf).select("event_id", "scrap_probability"),
                                 "event_id")
    return percentile_limits(c)


# --- P13: recent window per machine (anchor = max - 1 h) ----------------------
@register("recent_window", fixture_sql(f"""
SELECT h.machine_id, h.timestamp, h.variable_name, round(h.value, 9) AS value
FROM clean h JOIN (SELECT machine_id, max(timestamp) - INTERVAL 60 MINUTE AS anchor FROM clean GROUP BY 1) m
  USING (machine_id)
WHERE h.timestamp >= m.anchor - INTERVAL 240 MINUTE AND h.timestamp <= m.anchor"""))
def q_recent_window(spark, sf):
    r = recent_window(fx.clean(spark, sf), 240)
    return r.select("machine_id", _ntz(), "variable_name", _r9("value"))


# --- A10: dynamic limits of each machine's filled past window -----------------
@register("dynamic_limits", fixture_sql("""
SELECT machine_id, sensor, round(median, 9) AS median, round(std, 9) AS std,
       round(min_limit, 9) AS min_limit, round(max_limit, 9) AS max_limit, rule, ordinal
FROM dl""", O.history_cte(), O.filled_window_cte(WINDOW_MIN), O.dyn_limits_cte()))
def q_dynamic_limits(spark, sf):
    lim = window_limits(_filled(spark, sf), SENSORS, fx.tolerances(spark))
    return lim.select("machine_id", "sensor", _r9("median"), _r9("std"), _r9("min_limit"),
                      _r9("max_limit"), "rule", "ordinal")


# --- D6 + D7: root causes, adjusted risk and status per machine ---------------
@register("root_causes", fixture_sql("""
SELECT machine_id, timestamp, root_causes, breached_sensors, n_breached, round(base_risk, 9) AS base_risk,
       round(current_risk, 9) AS current_risk,
       CASE WHEN n_breached > 0 OR current_risk >= 0.55 THEN 'HIGH'
            WHEN current_risk >= 0.32 THEN 'MEDIUM' ELSE 'LOW' END AS status
FROM hl""", O.history_cte(), O.filled_window_cte(WINDOW_MIN), O.dyn_limits_cte(), O.health_cte()))
def q_root_causes(spark, sf):
    h = machine_health(_filled(spark, sf), SENSORS, fx.tolerances(spark))
    return h.select("machine_id", _ntz(), "root_causes", "breached_sensors",
                    F.col("n_breached").cast("int").alias("n_breached"),
                    _r9("base_risk"), _r9("current_risk"), "status")


# --- D2: rule-style violations of the latest values ---------------------------
@register("violations_rules", fixture_sql("""
SELECT l.machine_id, l.variable_name AS parameter, round(l.value, 9) AS current,
       '≤ ' || CAST(m.max_limit AS VARCHAR) AS safe_limit, round_even(l.value - m.max_limit, 3) AS deviation,
       'ABOVE_LIMIT' AS direction, m.ordinal
FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value > m.max_limit
UNION ALL
SELECT l.machine_id, l.variable_name, round(l.value, 9), '≥ ' || CAST(m.min_limit AS VARCHAR),
       round_even(m.min_limit - l.value, 3), 'BELOW_LIMIT', m.ordinal
FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value < m.min_limit""", """
latest AS (SELECT machine_id, variable_name, arg_max(value, timestamp) AS value
           FROM clean GROUP BY machine_id, variable_name)"""))
def q_violations_rules(spark, sf):
    v = violations(latest_values(fx.clean(spark, sf)), fx.limits(spark), style="rules")
    return v.withColumn("current", F.round("current", 9))


# --- D3/D4/D5: alert levels under the three presets ---------------------------
@register("alert_presets", fixture_sql("""
SELECT machine_id, round(p, 9) AS risk, CAST(n AS BIGINT) AS n_violations,
  CASE WHEN n > 0 THEN 'HIGH' WHEN p >= 0.55 THEN 'HIGH' WHEN p >= 0.32 THEN 'MEDIUM' ELSE 'LOW' END AS status_level,
  CASE WHEN n > 0 THEN 'CRITICAL' WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS decision_level,
  CASE WHEN n > 0 THEN 'SAFE_LIMIT_VIOLATION' WHEN p >= 0.4 THEN 'ML_RISK' ELSE 'NORMAL' END AS decision_reason,
  CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS live_level
FROM (SELECT r.machine_id, r.p, coalesce(v.n, 0) AS n
      FROM (SELECT machine_id, arg_max(scrap_probability, timestamp) AS p FROM scored GROUP BY 1) r
      LEFT JOIN (SELECT l.machine_id, count(*) AS n FROM latest l JOIN limits m ON l.variable_name = m.sensor
                 WHERE l.value > m.max_limit OR l.value < m.min_limit GROUP BY 1) v USING (machine_id)) t""", """
latest AS (SELECT machine_id, variable_name, arg_max(value, timestamp) AS value
           FROM clean GROUP BY machine_id, variable_name)"""))
def q_alert_presets(spark, sf):
    v = violations(latest_values(fx.clean(spark, sf)), fx.limits(spark)) \
        .groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))
    r = fx.scored(spark, sf).groupBy("machine_id").agg(
        F.max_by("scrap_probability", "timestamp").alias("p"))
    j = r.join(v, "machine_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s, d, li = (alert_level("n", "p", p) for p in ("status", "decision", "live"))
    return j.select("machine_id", _r9("p", "risk"), F.col("n").cast("long").alias("n_violations"),
                    s["alert_level"].alias("status_level"), d["alert_level"].alias("decision_level"),
                    d["decision_reason"].alias("decision_reason"), li["alert_level"].alias("live_level"))


# --- D8 + D9 + F2: UI breach list (top 3) and UI risk adjustment --------------
@register("ui_breaches", fixture_sql("""
SELECT b.machine_id, b.sensor, round(b.severity, 9) AS severity, b.severity_rank,
       round(least(1.0E0, c.base + least(0.35, 0.12 * c.nb)), 9) AS ui_risk,
       CASE WHEN least(1.0E0, c.base + least(0.35, 0.12 * c.nb)) >= 0.6 OR c.nb > 0 THEN 'HIGH'
            WHEN least(1.0E0, c.base + least(0.35, 0.12 * c.nb)) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS ui_status
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY severity DESC, ordinal) AS INTEGER) AS severity_rank
      FROM (SELECT c.machine_id, c.sensor, l.ordinal,
                   CASE WHEN c.value > l.max_limit THEN (c.value - l.max_limit) / sp
                        WHEN c.value < l.min_limit THEN (l.min_limit - c.value) / sp END AS severity
            FROM (SELECT c.*, greatest(coalesce(l.max_limit - l.min_limit, 0), coalesce(abs(l.max_limit), 0), 1) AS sp
                  FROM hl_cl c JOIN dl l USING (machine_id, sensor)) c
            JOIN dl l USING (machine_id, sensor)) s WHERE severity IS NOT NULL) b
JOIN (SELECT h.machine_id, coalesce(h.base_risk, 0) AS base,
             (SELECT count(*) FROM hl_cl c JOIN dl l USING (machine_id, sensor)
              WHERE c.machine_id = h.machine_id AND (c.value > l.max_limit OR c.value < l.min_limit)) AS nb
      FROM hl_cur h) c USING (machine_id)
WHERE b.severity_rank <= 3""", O.history_cte(), O.filled_window_cte(WINDOW_MIN), O.dyn_limits_cte(),
    O.health_cte()))
def q_ui_breaches(spark, sf):
    filled = _filled(spark, sf)
    lim = window_limits(filled, SENSORS, fx.tolerances(spark))
    cur = current_state(filled, SENSORS)
    cur_long = unpivot(cur, SENSORS, keys=("machine_id",), var="sensor")
    b = breach_severity_ui(cur_long, lim)
    nb = b.groupBy("machine_id").agg(F.count(F.lit(1)).alias("nb"))
    base = cur.select("machine_id", F.coalesce("scrap_probability", F.lit(0.0)).alias("base"))
    c = base.join(nb, "machine_id", "left").withColumn("nb", F.coalesce("nb", F.lit(0)))
    risk = adjusted_risk("base", "nb", step=0.12, cap=0.35)
    c = c.select("machine_id", risk.alias("ui_risk"),
                 risk_status(risk, "nb", high=0.6, medium=0.3).alias("ui_status"))
    top = b.where(F.col("severity_rank") <= 3)
    return top.join(c, "machine_id").select("machine_id", "sensor", _r9("severity"),
                                            "severity_rank", _r9("ui_risk"), "ui_status")


# --- D11 + D12: telemetry status grid and first abnormal sensor ---------------
@register("status_grid", fixture_sql("""
SELECT g.machine_id, g.sensor, round(g.value, 9) AS value, g.status, g.severity_rank, f.first_abnormal
FROM (SELECT c.machine_id, c.sensor, c.value, l.ordinal,
             CASE WHEN c.value IS NULL THEN 'unknown'
                  WHEN c.value > l.max_limit OR c.value < l.min_limit THEN 'critical'
                  WHEN c.value >= l.max_limit - sp * 0.1 OR c.value <= l.min_limit + sp * 0.1 THEN 'warning'
                  ELSE 'good' END AS status,
             CASE WHEN c.value IS NULL THEN 2
                  WHEN c.value > l.max_limit OR c.value < l.min_limit THEN 0
                  WHEN c.value >= l.max_limit - sp * 0.1 OR c.value <= l.min_limit + sp * 0.1 THEN 1
                  ELSE 2 END AS severity_rank
      FROM (SELECT l.*, coalesce(l.max_limit - l.min_limit, l.max_limit, l.min_limit, 100.0E0) AS sp FROM limits l) l
      JOIN (SELECT machine_id, variable_name AS sensor, arg_max(value, timestamp) AS value
            FROM clean GROUP BY 1, 2) c ON c.sensor = l.sensor) g
LEFT JOIN (SELECT machine_id, arg_min(sensor, severity_rank * 1000 + ordinal) AS first_abnormal
           FROM (SELECT c.machine_id, c.sensor, l.ordinal,
                        CASE WHEN c.value > l.max_limit OR c.value < l.min_limit THEN 0 ELSE 1 END AS severity_rank,
                        c.value > l.max_limit OR c.value < l.min_limit
                          OR c.value >= l.max_limit - sp * 0.1 OR c.value <= l.min_limit + sp * 0.1 AS abn
                 FROM (SELECT l.*, coalesce(l.max_limit - l.min_limit, l.max_limit, l.min_limit, 100.0E0) AS sp
                       FROM limits l) l
                 JOIN (SELECT machine_id, variable_name AS sensor, arg_max(value, timestamp) AS value
                       FROM clean GROUP BY 1, 2) c ON c.sensor = l.sensor) a
           WHERE abn GROUP BY machine_id) f USING (machine_id)"""))
def q_status_grid(spark, sf):
    cur = latest_values(fx.clean(spark, sf)).select(
        "machine_id", F.col("variable_name").alias("sensor"), "value")
    g = status_grid(cur, fx.limits(spark))
    f = first_abnormal(g)
    return g.join(f, "machine_id", "left").select("machine_id", "sensor", _r9("value"), "status",
                                                  "severity_rank", "first_abnormal")


# --- J9: limits override merge (override = percentile limits from the data) ---
@register("limits_override", fixture_sql("""
SELECT coalesce(b.sensor, o.sensor) AS sensor, coalesce(o.min_limit, b.min_limit) AS min_limit,
       coalesce(o.max_limit, b.max_limit) AS max_limit, b.unit AS unit, coalesce(b.ordinal, 10000) AS ordinal
FROM limits b FULL JOIN (
  SELECT variable_name AS sensor, round_even(quantile_cont(value, 0.01), 2) AS min_limit,
         round_even(quantile_cont(value, 0.99), 2) AS max_limit
  FROM clean c JOIN scored s USING (event_id) WHERE s.scrap_probability < 0.30
  GROUP BY variable_name) o ON o.sensor = b.sensor"""))
def q_limits_override(spark, sf):
    c = fx.clean(spark, sf).join(fx.scored(spark, sf).select("event_id", "scrap_probability"),
                                 "event_id")
    o = percentile_limits(c).withColumn("unit", F.lit(None).cast("string"))
    return merge_limits(fx.limits(spark), o)


# --- D18: RCA table with friendly labels ---------------------------------------
def _labels_sql():
    rows = ", ".join(f"('{s}', '{lbl}')" for s, lbl in config.PARAMETER_LABELS)
    return f"\nlabels_dim AS (SELECT * FROM (VALUES {rows}) AS t(sensor, label))"


@register("rca_table", fixture_sql("""
SELECT v.machine_id, coalesce(lb.label, replace(v.parameter, '_', ' ')) AS parameter_label,
       concat_ws(' ', CAST(v.current AS VARCHAR), v.unit) AS current_value, v."limit",
       concat_ws(' ', CAST(v.deviation AS VARCHAR), v.direction) AS deviation
FROM (SELECT l.machine_id, l.variable_name AS parameter, round_even(l.value, 2) AS current,
             m.max_limit AS "limit", m.unit, round_even(l.value - m.max_limit, 2) AS deviation, 'above' AS direction
      FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value > m.max_limit
      UNION ALL
      SELECT l.machine_id, l.variable_name, round_even(l.value, 2), m.min_limit, m.unit,
             round_even(m.min_limit - l.value, 2), 'below'
      FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value < m.min_limit) v
LEFT JOIN labels_dim lb ON lb.sensor = v.parameter""", """
latest AS (SELECT machine_id, variable_name, arg_max(value, timestamp) AS value
           FROM clean GROUP BY machine_id, variable_name)""", _labels_sql()))
def q_rca(spark, sf):
    v = violations(latest_values(fx.clean(spark, sf)), fx.limits(spark))
    return rca_table(v, config.labels_df(spark))


# --- P18 + P19: garbage guard and half-even rounding of history values --------
@register("garbage_guard", fixture_sql("""
SELECT event_id, machine_id, timestamp, variable_name,
       CASE WHEN abs(value) <= 5000 AND NOT isnan(value) THEN round_even(value, 2) END AS value_2dp
FROM clean"""))
def q_garbage(spark, sf):
    c = fx.clean(spark, sf)
    return c.select("event_id", "machine_id", _ntz(), "variable_name",
                    round_half_even(finite_or_null("value", 5000.0), 2).alias("value_2dp"))


# --- F3: strided downsample per machine (+ always the last), dedup on ts ------
@register("downsample_timeline", fixture_sql("""
SELECT machine_id, timestamp, round(scrap_probability, 9) AS scrap_probability
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY timestamp) - 1 AS idx,
             count(*) OVER (PARTITION BY machine_id) AS n FROM hist) t
WHERE n <= 320 OR idx % CAST(ceil(n / 320.0) AS BIGINT) = 0 OR idx = n - 1""", O.history_cte()))
def q_downsample(spark, sf):
    d = downsample_stride(fx.history(spark, sf), 320)
    return d.select("machine_id", _ntz(), _r9("scrap_probability"))


# --- F9: every 30th row when a machine has more than 1000 rows ---------------
@register("stride_30", fixture_sql("""
SELECT machine_id, timestamp, variable_name, round(value, 9) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY timestamp, event_id) - 1 AS idx,
             count(*) OVER (PARTITION BY machine_id) AS n FROM clean) t
WHERE n <= 1000 OR idx % 30 = 0"""))
def q_stride(spark, sf):
    s = stride_every(fx.clean(spark, sf), 30, min_rows=1000, tie="event_id")
    return s.select("machine_id", _ntz(), "variable_name", _r9("value"))


# --- F11: recent tail of <= 240 rows per machine ------------------------------
@register("recent_tail", fixture_sql("""
SELECT machine_id, timestamp, round(scrap_probability, 9) AS scrap_probability, tail_rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY timestamp DESC) AS INTEGER) AS tail_rank FROM hist) t
WHERE tail_rank <= 240""", O.history_cte()))
def q_tail(spark, sf):
    t = recent_tail(fx.history(spark, sf), 240)
    return t.select("machine_id", _ntz(), _r9("scrap_probability"), "tail_rank")
