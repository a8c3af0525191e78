"""Reference SQL for the registered queries (run by DuckDB on the raw tables).

The fixture views are written once in the SQL dialect both engines accept;
each query's oracle text is ``fixture_sql(...)`` + its own CTEs + SELECT.
"""
from __future__ import annotations

from moldwatch import config

NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

_TELEMETRY = """
telemetry AS (
  SELECT event_id, ts AS timestamp,
         'm-' || CAST(100 + user_id % 5 AS VARCHAR(10)) AS machine_id,
         CASE WHEN event_id % 89 = 0 THEN 'Scrap_counter' ELSE CASE event_type WHEN 'click' THEN 'Injection_pressure' WHEN 'view' THEN 'Cycle_time'
                         WHEN 'purchase' THEN 'Cushion' ELSE 'Cyl_tmp_z1' END END AS variable_name,
         CASE WHEN event_id % 97 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR(32)) END AS value,
         'LINE-' || CAST(100 + user_id % 5 AS VARCHAR(10)) || '-' ||
           CASE user_id % 5 WHEN 0 THEN '11' WHEN 1 THEN '23' WHEN 2 THEN '30' WHEN 3 THEN '33' ELSE '57' END
           AS machine_definition
  FROM events WHERE event_type <> 'error')"""

_PRODUCTION_LOG = """
production_log AS (
  SELECT event_id AS machine_event_record_id,
         'M-' || CAST(100 + user_id % 5 AS VARCHAR(10)) AS machine_id,
         date_trunc('day', ts) AS machine_event_create_date,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INT) AS machine_event_create_time,
         CASE WHEN event_id % 3 = 0 THEN 100 ELSE 200 END AS machine_status_code,
         CAST(event_id % 4 AS INT) AS scrap_quantity, CAST(10 + event_id % 7 AS INT) AS yield_quantity,
         ts AS event_end
  FROM events WHERE event_type = 'error')"""

_SCORED = """
scored AS (
  SELECT event_id, ts AS timestamp, 'M' || CAST(100 + user_id % 5 AS VARCHAR(10)) AS machine_id,
         LEAST(value / 500.0E0, 1.0E0) AS scrap_probability, CAST(event_id % 11 = 0 AS INT) AS is_scrap_actual
  FROM events)"""

_EXCLUDED = ", ".join(f"'{v}'" for v in config.EXCLUDED_VARIABLES)

_CLEAN = f"""
clean AS (
  SELECT event_id, CASE WHEN starts_with(c, 'M') THEN c ELSE 'M' || c END AS machine_id,
         timestamp, variable_name, v AS value
  FROM (SELECT *, upper(regexp_replace(coalesce(machine_id, ''), '[^A-Za-z0-9]', '', 'g')) AS c,
               CASE WHEN regexp_matches(value, '{NUMERIC_TEXT}') THEN TRY_CAST(trim(value) AS DOUBLE) END AS v
        FROM telemetry) t
  WHERE v IS NOT NULL AND NOT isnan(v) AND timestamp IS NOT NULL
    AND variable_name NOT IN ({_EXCLUDED}))"""

# Production events, training rule: scrap > 0, status 200, time = date + seconds.
_EVENTS = """
prod_events AS (
  SELECT machine_event_record_id AS event_record_id,
         trim(upper(replace(machine_id, '-', ''))) AS machine_id,
         make_timestamp(epoch_us(date_trunc('day', machine_event_create_date))
                        + CAST(coalesce(CAST(machine_event_create_time AS DOUBLE), 0) * 1000000 AS BIGINT)) AS event_ts,
         scrap_quantity, yield_quantity, CAST(scrap_quantity > 0 AS INT) AS is_scrap
  FROM production_log
  WHERE scrap_quantity > 0 AND machine_status_code IN (200))"""


def _num(x):
    return "NULL" if x is None else f"CAST({float(x)!r} AS DOUBLE)"


def _str(x):
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def limits_cte(name="limits", limits=None):
    rows = ", ".join(f"({_str(s)}, {_num(lo)}, {_num(hi)}, {_str(u)}, {i})"
                     for i, (s, lo, hi, u) in enumerate(limits or config.FIXTURE_LIMITS))
    return f"\n{name} AS (SELECT * FROM (VALUES {rows}) AS t(sensor, min_limit, max_limit, unit, ordinal))"


def tolerances_cte(name="tolerances"):
    rows = ", ".join(f"({_str(s)}, {_num(p)}, {_num(m)})" for s, p, m in config.FIXTURE_TOLERANCES)
    return (f"\n{name} AS (SELECT * FROM (VALUES {rows}) "
            "AS t(variable_name, tolerance_plus, tolerance_minus))")


def machines_cte(name="machines"):
    rows = ", ".join(f"({_str(m)})" for m in config.FIXTURE_MACHINES)
    return f"\n{name} AS (SELECT * FROM (VALUES {rows}) AS t(machine_id))"


BASE_CTES = [_TELEMETRY, _PRODUCTION_LOG, _SCORED, _CLEAN, _EVENTS]


def fixture_sql(body: str, *ctes: str) -> str:
    """``WITH <fixture views>, <ctes> <body>``; ``body`` is the final query."""
    parts = BASE_CTES + [limits_cte(), tolerances_cte(), machines_cte()] + list(ctes)
    return "WITH " + ",".join(parts) + "\n" + body


def wide_sql(sensors=None, round_to=9, source="clean"):
    sensors = sensors or config.FIXTURE_SENSORS
    cols = ",\n       ".join(
        (f"round(avg(value) FILTER (WHERE variable_name = '{s}'), {round_to}) AS {s}" if round_to
         else f"avg(value) FILTER (WHERE variable_name = '{s}') AS {s}") for s in sensors)
    return f"SELECT machine_id, timestamp,\n       {cols}\nFROM {source} GROUP BY machine_id, timestamp"


def history_cte(name="hist"):
    """Scored wide history: pivot + score, clip, idle mask."""
    s = ", ".join(f"w.{x}" for x in config.FIXTURE_SENSORS)
    return f"""
{name}_w AS ({wide_sql(round_to=None)}),
{name} AS (
  SELECT w.machine_id, w.timestamp, {s},
         CASE WHEN coalesce(w.Cycle_time, 0) < 0.5 THEN 0.0E0
              ELSE least(greatest(coalesce(CASE WHEN isnan(s.scrap_probability) THEN NULL
                                                ELSE s.scrap_probability END, 0.0E0), 0.0E0), 1.0E0) END
           AS scrap_probability,
         CASE WHEN coalesce(w.Cycle_time, 0) < 0.5 THEN 0 ELSE coalesce(s.is_scrap_actual, 0) END
           AS is_scrap_actual
  FROM {name}_w w LEFT JOIN scored s ON s.machine_id = w.machine_id AND s.timestamp = w.timestamp)"""


def filled_window_cte(minutes, name="fw", src="hist", anchor_minutes=60):
    """Recent window per machine + forward/back fill inside it."""
    cols = list(config.FIXTURE_SENSORS) + ["scrap_probability", "is_scrap_actual"]
    fill = ",\n  ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY timestamp "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER "
        f"(PARTITION BY machine_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in cols)
    return f"""
{name}_mx AS (SELECT machine_id, max(timestamp) - INTERVAL {anchor_minutes} MINUTE AS anchor
              FROM {src} GROUP BY machine_id),
{name}_win AS (SELECT h.* FROM {src} h JOIN {name}_mx m USING (machine_id)
               WHERE h.timestamp >= m.anchor - INTERVAL {minutes} MINUTE AND h.timestamp <= m.anchor),
{name} AS (SELECT machine_id, timestamp,\n  {fill}\nFROM {name}_win)"""


def unpivot_sql(src, sensors=None, keys="machine_id, timestamp", var="variable_name"):
    sensors = sensors or config.FIXTURE_SENSORS
    return "\nUNION ALL ".join(f"SELECT {keys}, '{s}' AS {var}, {s} AS value FROM {src}" for s in sensors)


def dyn_limits_cte(name="dl", src="fw"):
    signed = " OR ".join(f"lower(variable_name) LIKE '%{k}%'" for k in ("deviation", "offset", "tmp"))
    excl = ", ".join(f"'{c}'" for c in config.NON_SENSOR_COLUMNS)
    order = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(config.FIXTURE_SENSORS))
    return f"""
{name}_long AS ({unpivot_sql(src)}),
{name}_st AS (SELECT machine_id, variable_name, quantile_cont(value, 0.5) AS median,
                     coalesce(stddev_samp(value), 0.0E0) AS std
              FROM {name}_long WHERE value IS NOT NULL GROUP BY machine_id, variable_name),
{name}_j AS (SELECT s.*, t.tolerance_plus, t.tolerance_minus,
                    t.tolerance_plus IS NOT NULL AND t.tolerance_minus IS NOT NULL AS both_tol
             FROM {name}_st s JOIN tolerances t USING (variable_name)
             WHERE variable_name NOT IN ({excl})),
{name}_raw AS (SELECT machine_id, variable_name, median, std, both_tol,
   CASE WHEN both_tol THEN median - abs(tolerance_minus)
        ELSE median - greatest(std * 3, abs(median) * 0.05) END AS lo,
   CASE WHEN both_tol THEN median + abs(tolerance_plus)
        ELSE median + greatest(std * 3, abs(median) * 0.05) END AS hi
   FROM {name}_j),
{name} AS (SELECT machine_id, variable_name AS sensor, median, std,
   CASE WHEN {signed} THEN lo ELSE greatest(0.0E0, lo) END AS min_limit, hi AS max_limit,
   CASE WHEN both_tol THEN 'tolerance' ELSE 'sigma' END AS rule,
   CASE variable_name {order} END AS ordinal
   FROM {name}_raw)"""


def health_cte(name="hl", src="fw", lim="dl", top=3):
    cur_cols = ", ".join(f"arg_max({s}, timestamp) AS {s}" for s in config.FIXTURE_SENSORS)
    return f"""
{name}_cur AS (SELECT machine_id, max(timestamp) AS timestamp, {cur_cols},
                      arg_max(scrap_probability, timestamp) AS base_risk
               FROM {src} GROUP BY machine_id),
{name}_cl AS ({unpivot_sql(name + '_cur', keys='machine_id', var='sensor')}),
{name}_sv AS (
  SELECT c.machine_id, c.sensor, l.ordinal,
         CASE WHEN c.value > l.max_limit THEN (c.value - l.max_limit) / sp
              WHEN c.value < l.min_limit THEN (l.min_limit - c.value) / sp END AS breach,
         1 - least(least(abs(c.value - l.min_limit), abs(l.max_limit - c.value)) / sp, 1) AS near
  FROM (SELECT c.*, greatest(coalesce(abs(l.max_limit - l.min_limit), 0), coalesce(abs(l.max_limit), 0),
                              coalesce(abs(l.min_limit), 0), 1) AS sp
        FROM {name}_cl c JOIN {lim} l ON l.machine_id = c.machine_id AND l.sensor = c.sensor) c
  JOIN {lim} l ON l.machine_id = c.machine_id AND l.sensor = c.sensor
  WHERE c.value IS NOT NULL),
{name}_f AS (SELECT machine_id, sensor, ordinal, breach IS NOT NULL AS breached,
                    coalesce(breach, near) AS severity,
                    max(CAST(breach IS NOT NULL AND breach >= 0.01 AS INT)) OVER (PARTITION BY machine_id) AS anyb
             FROM {name}_sv WHERE (breach IS NULL OR breach >= 0.01) AND coalesce(breach, near) IS NOT NULL),
{name}_rc AS (SELECT machine_id,
    array_to_string(list_slice(list(sensor ORDER BY severity DESC, ordinal), 1, {top}), ',') AS root_causes,
    CASE WHEN max(anyb) = 1 THEN string_agg(sensor, ',' ORDER BY severity DESC, ordinal) ELSE '' END
      AS breached_sensors,
    CASE WHEN max(anyb) = 1 THEN count(*) ELSE 0 END AS n_breached
  FROM {name}_f WHERE anyb = 0 OR breached GROUP BY machine_id),
{name} AS (
  SELECT c.machine_id, c.timestamp, coalesce(r.root_causes, '') AS root_causes,
         coalesce(r.breached_sensors, '') AS breached_sensors,
         CAST(coalesce(r.n_breached, 0) AS INT) AS n_breached, c.base_risk,
         least(1.0E0, coalesce(c.base_risk, 0) + least(0.25, 0.06 * coalesce(r.n_breached, 0))) AS current_risk
  FROM {name}_cur c LEFT JOIN {name}_rc r USING (machine_id))"""
