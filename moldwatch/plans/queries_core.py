"""Registered queries: ingest, latest state, limits, status (steps 0-1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch.operators.latest import latest_values
from moldwatch.operators.limits import violations
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.plans.status import machine_status


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


# --- flagship: latest state -> violations -> alert level --------------------
@register("machine_status", fixture_sql("""
SELECT m.machine_id, t.timestamp,
       round(CASE WHEN t.timestamp IS NULL THEN 0.0E0 ELSE coalesce(r.p, 0.0E0) END, 9) AS ml_risk_probability,
       CAST(coalesce(v.n_violations, 0) AS BIGINT) AS n_violations,
       coalesce(v.violated, '') AS violated,
       CASE WHEN t.timestamp IS NULL THEN 'LOW' WHEN coalesce(v.n_violations, 0) > 0 THEN 'HIGH'
            WHEN r.p >= 0.55 THEN 'HIGH' WHEN r.p >= 0.32 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level,
       CASE WHEN t.timestamp IS NULL THEN 'NO DATA' WHEN coalesce(v.n_violations, 0) > 0 THEN 'SAFETY VIOLATION'
            WHEN r.p >= 0.55 THEN 'AI RISK PREDICTION' WHEN r.p >= 0.32 THEN 'AI WARNING' ELSE 'OPTIMAL' END
         AS decision_reason
FROM machines m LEFT JOIN last_ts t USING (machine_id) LEFT JOIN vagg v USING (machine_id)
     LEFT JOIN risk r USING (machine_id)""", """
latest AS (SELECT machine_id, variable_name, arg_max(value, timestamp) AS value
           FROM clean GROUP BY machine_id, variable_name)""", """
viol AS (
  SELECT l.machine_id, l.variable_name AS parameter, m.ordinal, 'above' AS direction
  FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value > m.max_limit
  UNION ALL
  SELECT l.machine_id, l.variable_name, m.ordinal, 'below'
  FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value < m.min_limit)""", """
vagg AS (SELECT machine_id, count(*) AS n_violations,
                string_agg(parameter, ',' ORDER BY ordinal, direction) AS violated
         FROM viol GROUP BY machine_id)""", """
last_ts AS (SELECT machine_id, max(timestamp) AS timestamp FROM clean GROUP BY machine_id)""", """
risk AS (SELECT machine_id, arg_max(scrap_probability, timestamp) AS p FROM scored GROUP BY machine_id)"""))
def q_machine_status(spark, sf):
    return machine_status(fx.clean(spark, sf), fx.scored(spark, sf), fx.limits(spark),
                          fx.machines(spark))


# --- P1-P3, P11: cleaned long telemetry ---------------------------------------
@register("telemetry_clean", fixture_sql("""
SELECT event_id, machine_id, timestamp, variable_name, round(value, 9) AS value FROM clean"""))
def q_telemetry_clean(spark, sf):
    c = fx.clean(spark, sf)
    return c.select("event_id", "machine_id", _ntz(), "variable_name",
                    F.round("value", 9).alias("value"))


# --- P4, P9, P10, P22: production log -> scrap events -------------------------
@register("production_scrap_events", fixture_sql("""
SELECT event_record_id, machine_id, event_ts, scrap_quantity, yield_quantity, is_scrap
FROM prod_events"""))
def q_production_events(spark, sf):
    e = fx.events(spark, sf)
    return e.select("event_record_id", "machine_id", _ntz("event_ts"), "scrap_quantity",
                    "yield_quantity", "is_scrap")


# --- J8 + D1: violations of each machine's latest values ----------------------
@register("limit_violations", fixture_sql("""
SELECT l.machine_id, l.variable_name AS parameter, round_even(l.value, 2) AS current,
       m.max_limit AS "limit", m.unit, round_even(l.value - m.max_limit, 2) AS deviation,
       'above' AS direction, m.ordinal
FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value > m.max_limit
UNION ALL
SELECT l.machine_id, l.variable_name, round_even(l.value, 2), m.min_limit, m.unit,
       round_even(m.min_limit - l.value, 2), 'below', m.ordinal
FROM latest l JOIN limits m ON l.variable_name = m.sensor WHERE l.value < m.min_limit""", """
latest AS (SELECT machine_id, variable_name, arg_max(value, timestamp) AS value
           FROM clean GROUP BY machine_id, variable_name)"""))
def q_limit_violations(spark, sf):
    latest = latest_values(fx.clean(spark, sf))
    return violations(latest, fx.limits(spark))
