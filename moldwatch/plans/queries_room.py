"""Registered queries: the control room (step 11: D17 with D10, D13, D14,
D16, A25, A26, U3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import normalize_machine_id
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans import oracle as O
from moldwatch.plans.control_room import control_room, future_horizon, payload, telemetry_table
from moldwatch.plans.monitor import filled_window, window_limits
from moldwatch.plans.oracle import fixture_sql
from moldwatch.plans.training import raw_sensor_model
from moldwatch.sources.tables import telemetry_raw

SENSORS = config.FIXTURE_SENSORS
TIME_WINDOW = 4320   # fixture scale of the 240-minute past window
FUTURE_WINDOW = 35
MAX_PAST, MAX_FUTURE = 320, 210  # points of a machine's timeline

_CACHE: dict = {}


def _forecaster(spark, sf):
    from moldwatch.plans.queries_forecast import sensor_forecaster
    coef, icpt = sensor_forecaster(spark, sf, 3)
    return coef, icpt, 3


def room(spark, sf):
    key = (sf, id(spark))
    if key not in _CACHE:
        raw = telemetry_raw(spark, sf).withColumn("machine_id", normalize_machine_id("machine_id"))
        _CACHE[key] = control_room(fx.history(spark, sf), raw, fx.machines(spark), SENSORS,
                                   fx.tolerances(spark), raw_sensor_model(spark, sf),
                                   _forecaster(spark, sf), time_window=TIME_WINDOW,
                                   future_window=FUTURE_WINDOW, max_past=MAX_PAST, max_future=MAX_FUTURE)
    return _CACHE[key]


@register("control_room")
def q_control_room(spark, sf):
    """The machines of the control room: past window TIME_WINDOW minutes, FUTURE_WINDOW minutes ahead."""
    return room(spark, sf)[0]


@register("control_room_timeline")
def q_control_room_timeline(spark, sf):
    """The control room's timeline, at most MAX_PAST + MAX_FUTURE points a machine."""
    return room(spark, sf)[1]


@register("telemetry_forecast_table")
def q_telemetry_table(spark, sf):
    filled = filled_window(fx.history(spark, sf), SENSORS, TIME_WINDOW)
    lim = window_limits(filled, SENSORS, fx.tolerances(spark))
    fut = future_horizon(filled, SENSORS, raw_sensor_model(spark, sf), _forecaster(spark, sf),
                         FUTURE_WINDOW)
    t = telemetry_table(filled, fut, lim, SENSORS)
    return t.select("machine_id", "sensor", F.round("value", 9).alias("value"),
                    F.round("min_limit", 9).alias("min_limit"), F.round("max_limit", 9).alias("max_limit"),
                    "status", "severity_rank", F.round("last_forecast", 9).alias("last_forecast"))


# --- D17 with a fixed scoring rule and flat forecasts: every column has its SQL --------------
RULE = ("Injection_pressure", 50.0, 0.25, 0.75)


def rule(rows):
    """Adds the fixed rule's probability: one of two values."""
    sensor, cut, low, high = RULE
    return rows.withColumn("scrap_probability", F.when(F.col(sensor) <= cut, low).otherwise(high))


def _payload_sql():
    sensor, cut, low, high = RULE
    cols = ", ".join(SENSORS)
    shown = ", ".join(f"CASE WHEN abs(t.{s}) <= 5000 AND l.{s}_max IS NOT NULL THEN round_even(t.{s}, 2) END AS {s}" for s in SENSORS)
    lims = ", ".join(f"round_even(max({b}_limit) FILTER (WHERE sensor = '{s}'), 2) AS {s}_{b}" for s in SENSORS for b in ("min", "max"))
    names = ", ".join(f"l.{s}_{b}" for s in SENSORS for b in ("min", "max"))
    return (f"""
SELECT m.machine_id, substr(m.machine_id, 1, 1) || '-' || substr(m.machine_id, 2) AS display_id,
  CASE WHEN h.machine_id IS NULL THEN 'OFFLINE' WHEN h.n_breached > 0 OR h.current_risk >= 0.55 THEN 'HIGH'
       WHEN h.current_risk >= 0.32 THEN 'MEDIUM' ELSE 'LOW' END AS status,
  coalesce(round_even(h.current_risk, 2), 0.0E0) AS risk_score,
  CASE WHEN h.machine_id IS NULL THEN '' WHEN h.root_causes = '' THEN 'Injection_pressure' ELSE h.root_causes END AS root_causes,
  coalesce(ps.n, 0) AS past_scrap_detected, coalesce(fs.n, 0) AS future_scrap_predicted,
  CAST(t.position AS INT) AS position, t.ts AS timestamp, t.is_future, t.risk AS point_risk,
  round(CASE WHEN t.is_future THEN least(1.0E0, t.risk + least(0.2, 0.05 * h.n_breached))
       WHEN t.ts = t.last_past THEN greatest(t.risk, h.current_risk) ELSE t.risk END, 9) AS adjusted_risk,
  t.scrap AS is_scrap_actual, t.scrap >= 1 OR (t.is_future AND t.risk > 0.6) AS alert_dot, {shown}, {names}
FROM machines m LEFT JOIN hl h USING (machine_id) LEFT JOIN ry t USING (machine_id) LEFT JOIN rl l USING (machine_id)
LEFT JOIN (SELECT machine_id, CAST(count(*) FILTER (is_scrap_actual >= 1) AS BIGINT) AS n FROM fw GROUP BY 1) ps USING (machine_id)
LEFT JOIN (SELECT machine_id, CAST(count(*) FILTER (p >= 0.55) AS BIGINT) AS n FROM rf GROUP BY 1) fs USING (machine_id)""", f"""
rp0 AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY machine_id) AS n FROM fw),
rp AS (SELECT * FROM rp0 WHERE n <= {MAX_PAST} OR i % CAST(ceil(n / {MAX_PAST}.0) AS BIGINT) = 0 OR i = n - 1),
rf AS (SELECT machine_id, timestamp + k * INTERVAL 1 MINUTE AS timestamp, {cols},
    CASE WHEN coalesce(Cycle_time, 0) < 0.5 THEN 0.0E0 WHEN coalesce({sensor}, 0) <= {cut} THEN {low}E0 ELSE {high}E0 END AS p
    FROM (SELECT * FROM rp0 WHERE i = n - 1) CROSS JOIN range(1, {FUTURE_WINDOW + 1}) r(k)),
rx AS (SELECT machine_id, false AS is_future, timestamp, {cols}, scrap_probability AS p, CAST(coalesce(is_scrap_actual, 0) AS INT) AS scrap FROM rp
    UNION ALL SELECT machine_id, true, timestamp, {", ".join(f"coalesce({s}, 0) AS {s}" for s in SENSORS)}, p, 0 FROM rf),
ry AS (SELECT *, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, round_even(coalesce(p, 0), 2) AS risk,
    row_number() OVER (PARTITION BY machine_id ORDER BY is_future, timestamp) - 1 AS position,
    max(strftime(timestamp, '%Y-%m-%d %H:%M:%S')) FILTER (NOT is_future) OVER (PARTITION BY machine_id) AS last_past FROM rx),
rl AS (SELECT machine_id, {lims} FROM dl GROUP BY machine_id)""")


_PAYLOAD_SQL = _payload_sql()


@register("control_room_payload", fixture_sql(_PAYLOAD_SQL[0], O.history_cte(), O.filled_window_cte(TIME_WINDOW), O.dyn_limits_cte(),
                                              O.health_cte(), _PAYLOAD_SQL[1]))
def q_payload(spark, sf):
    """The nested rows, read back point by point."""
    raw = telemetry_raw(spark, sf).withColumn("machine_id", normalize_machine_id("machine_id"))
    hist, tol = fx.history(spark, sf), fx.tolerances(spark)
    table, timeline = control_room(hist, raw, fx.machines(spark), SENSORS, tol, rule, None, time_window=TIME_WINDOW,
                                   future_window=FUTURE_WINDOW, max_past=MAX_PAST, max_future=MAX_FUTURE)
    nested = payload(table, timeline, window_limits(filled_window(hist, SENSORS, TIME_WINDOW), SENSORS, tol))
    x = nested.select("machine_id", "display_id", "health", "limits", F.posexplode_outer("timeline").alias("position", "p"))
    return x.select(
        "machine_id", "display_id", "health.status", "health.risk_score", "health.root_causes", "health.past_scrap_detected",
        "health.future_scrap_predicted", "position", "p.timestamp", "p.is_future", F.col("p.risk_score").alias("point_risk"),
        F.round("p.adjusted_risk", 9).alias("adjusted_risk"), "p.is_scrap_actual", "p.alert_dot",
        *[F.col("p.sensors")[s].alias(s) for s in SENSORS],
        *[F.col("limits")[s][b].alias(f"{s}_{b}") for s in SENSORS for b in ("min", "max")])
