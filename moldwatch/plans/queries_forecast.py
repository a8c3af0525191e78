"""Registered queries: forecasts (step 8: M1, M2, M4, M6, A29, W11 -> ML6 -> M3)."""
from __future__ import annotations

from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.forecast import (clamp_garbage, fallback_forecast, recursive_linear_forecast,
                                          recursive_tree_forecast, trend_forecast, window_mean)
from moldwatch.operators.ingest import recent_window
from moldwatch.operators.latest import idle_by_last_rows, latest_row, latest_values
from moldwatch.operators.rolling import fill_forward_backward, lag_features
from moldwatch.plans import fixtures as fx
from moldwatch.plans import oracle as O
from moldwatch.plans.catalog import register
from moldwatch.plans.monitor import filled_window, unpivot
from moldwatch.plans.oracle import fixture_sql
from moldwatch.session import stored

SENSORS = config.FIXTURE_SENSORS
TREND_WINDOW_MIN, FIT_MIN, FUTURE_MIN = 4320, 1440, 1440  # fixture scale of 30 / 15 / 60 min
PAST_WINDOW_MIN, FUTURE_STEPS = 4320, 35


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _r9(c, name=None):
    return F.round(c, 9).alias(name or c)


_TW = f"""
tw_mx AS (SELECT machine_id, max(timestamp) - INTERVAL 60 MINUTE AS anchor FROM hist GROUP BY 1),
tw AS (SELECT h.* FROM hist h JOIN tw_mx m USING (machine_id)
       WHERE h.timestamp >= m.anchor - INTERVAL {TREND_WINDOW_MIN} MINUTE AND h.timestamp <= m.anchor),
tl AS ({O.unpivot_sql('tw', var='sensor')}),
tsp AS (SELECT machine_id, min(epoch_us(timestamp)) AS t0, max(epoch_us(timestamp)) AS t1, max(timestamp) AS last
        FROM tl GROUP BY 1),
tx AS (SELECT tl.*, (epoch_us(timestamp) - t0) / 1e6 AS x, (t1 - t0) / 1e6 AS lat, last FROM tl JOIN tsp USING (machine_id)),
tfit AS (SELECT machine_id, sensor, regr_slope(value, x) AS b, regr_intercept(value, x) AS a,
                any_value(lat) AS lat, any_value(last) AS last
         FROM tx WHERE x >= lat - {FIT_MIN * 60}.0 GROUP BY 1, 2 HAVING regr_count(value, x) >= 10),
tidle AS (SELECT machine_id, count(Cycle_time) = 0 OR coalesce(avg(Cycle_time), 0) < 0.5 AS is_idle
          FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY timestamp DESC) AS rn FROM tw) t
          WHERE rn <= 5 GROUP BY 1),
tlast AS (SELECT machine_id, sensor, arg_max(value, timestamp) FILTER (WHERE value IS NOT NULL) AS last_actual
          FROM tl GROUP BY 1, 2)"""


# --- M1 + M2 + M6: linear trend forecast with idle override and garbage clamp -
@register("trend_forecast", fixture_sql(f"""
SELECT machine_id, sensor, timestamp, round(value, 9) AS value, type FROM (
  SELECT machine_id, sensor, timestamp, value, 'history' AS type FROM tl
  UNION ALL
  SELECT f.machine_id, f.sensor,
         make_timestamp(epoch_us(f.last) + CAST(floor(r.k * {FUTURE_MIN * 60 / 9}) AS BIGINT) * 1000000) AS timestamp,
         CASE WHEN coalesce(i.is_idle, false) THEN 0.0E0
              WHEN isnan(f.a + f.b * (f.lat + r.k * {FUTURE_MIN * 60 / 9}))
                OR abs(f.a + f.b * (f.lat + r.k * {FUTURE_MIN * 60 / 9})) > 1e6 THEN la.last_actual
              ELSE f.a + f.b * (f.lat + r.k * {FUTURE_MIN * 60 / 9}) END AS value,
         'prediction' AS type
  FROM tfit f CROSS JOIN range(0, 10) r(k) LEFT JOIN tidle i USING (machine_id)
  LEFT JOIN tlast la USING (machine_id, sensor)) u""", O.history_cte(), _TW))
def q_trend(spark, sf):
    win = recent_window(fx.history(spark, sf), TREND_WINDOW_MIN)
    long = unpivot(win, SENSORS, var="sensor")
    idle = idle_by_last_rows(win)
    t = trend_forecast(long, fit_minutes=FIT_MIN, future_minutes=FUTURE_MIN, idle=idle)
    last = latest_values(long.where(F.col("value").isNotNull()), keys=("machine_id",), var="sensor",
                         tie=None).select("machine_id", "sensor", F.col("value").alias("_la"))
    t = t.join(last, ["machine_id", "sensor"], "left").withColumn(
        "value", F.when(F.col("type") == "prediction", clamp_garbage("value", "_la"))
        .otherwise(F.col("value")))
    return t.select("machine_id", "sensor", _ntz(), _r9("value"), "type")


# --- M4 + A29: EMA fallback toward the window mean, and flat carry-forward ----
@register("fallback_forecast", fixture_sql(f"""
SELECT l.machine_id, l.sensor, s.step,
       l.last_ts + s.step * INTERVAL 1 MINUTE AS timestamp,
       round(round(coalesce(m.mu, l.last) + (l.last - coalesce(m.mu, l.last)) * pow(0.95, s.step), 6), 9) AS ema_value,
       round(l.last, 9) AS flat_value
FROM (SELECT machine_id, sensor, arg_max(value, timestamp) AS last, max(timestamp) AS last_ts
      FROM fl WHERE value IS NOT NULL GROUP BY 1, 2) l
JOIN (SELECT machine_id, sensor, avg(value) AS mu FROM fl GROUP BY 1, 2) m USING (machine_id, sensor)
CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(1, {FUTURE_STEPS + 1})) s""", O.history_cte(),
    O.filled_window_cte(PAST_WINDOW_MIN), f"\nfl AS ({O.unpivot_sql('fw', var='sensor')})"))
def q_fallback(spark, sf):
    f = filled_window(fx.history(spark, sf), SENSORS, PAST_WINDOW_MIN)
    long = unpivot(f.select("machine_id", "timestamp", *SENSORS), SENSORS, var="sensor")
    last = latest_values(long.where(F.col("value").isNotNull()), keys=("machine_id",), var="sensor",
                         tie=None)
    ema = fallback_forecast(last, window_mean(long), FUTURE_STEPS)
    flat = fallback_forecast(last, None, FUTURE_STEPS).select(
        "machine_id", "sensor", "step", F.col("value").alias("flat_value"))
    j = ema.join(flat, ["machine_id", "sensor", "step"])
    return j.select("machine_id", "sensor", "step", _ntz(), _r9("value", "ema_value"),
                    _r9("flat_value"))


# --- ML6 + M3 + M6: linear lagged forecaster, recursive multi-step forecast ---
def sensor_forecaster(spark, sf, lags: int = 3):
    from moldwatch.ml.models import fit_linear_forecaster
    filled = fill_forward_backward(fx.history(spark, sf).select("machine_id", "timestamp", *SENSORS),
                                   SENSORS)
    lagged = lag_features(filled, SENSORS, lags)
    return fit_linear_forecaster(lagged, SENSORS, lags)


@register("recursive_forecast")
def q_recursive(spark, sf):
    lags = 3
    coef, icpt = sensor_forecaster(spark, sf, lags)
    f = filled_window(fx.history(spark, sf), SENSORS, PAST_WINDOW_MIN)
    fc = recursive_linear_forecast(f, SENSORS, coef, icpt, lags, steps=max(6, FUTURE_STEPS))
    last = latest_row(f.select("machine_id", "timestamp", *SENSORS)).select(
        "machine_id", *[F.col(s).alias(f"_la_{s}") for s in SENSORS])
    fc = fc.join(last, "machine_id", "left")
    return fc.select("machine_id", "step", _ntz(),
                     *[_r9(clamp_garbage(F.col(s), F.col(f"_la_{s}")), s) for s in SENSORS])



# --- ML6 + M3 with boosted trees: both presets drive the recursion -------------
def tree_forecaster(spark, sf, preset: str):
    """(forest per sensor, features, lags) of a preset, fitted on the filled history; each sensor's
    model is kept like the classifiers'."""
    from moldwatch.ml import models as ML
    from moldwatch.ml.trees import forest_of
    lags = config.FORECASTER_PRESETS[preset][3]
    lagged = stored(lag_features(_filled(spark, sf), SENSORS, lags), "lagged")
    models = ML.fitted_forecaster(spark, lagged, SENSORS, preset)
    with ThreadPool(len(SENSORS)) as pool:
        forests = pool.map(inheritable_thread_target(spark)(lambda s: forest_of(spark, models[s].stages[-1])), list(SENSORS))
    return dict(zip(SENSORS, forests)), ML.forecaster_features(SENSORS, preset), lags


_FILLED_CACHE: dict = {}
_FILLING = Lock()


def _filled(spark, sf):
    """The filled history, computed once per input: every preset's lags and their row numbers read it."""
    key = (sf, id(spark))
    with _FILLING:
        if key not in _FILLED_CACHE:
            _FILLED_CACHE[key] = stored(fill_forward_backward(fx.history(spark, sf).select("machine_id", "timestamp", *SENSORS), SENSORS), "filled")
    return _FILLED_CACHE[key]


def tree_forecasters(spark, sf) -> dict:
    """:func:`tree_forecaster` of every preset, side by side: what one does alone, like reading and writing models, leaves
    cores idle."""
    presets = sorted(config.FORECASTER_PRESETS)
    with ThreadPool(len(presets)) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(lambda preset: tree_forecaster(spark, sf, preset)), presets)
    return dict(zip(presets, fitted))


@register("recursive_forecast_trees")
def q_recursive_trees(spark, sf):
    f = filled_window(fx.history(spark, sf), SENSORS, PAST_WINDOW_MIN)
    last = latest_row(f.select("machine_id", "timestamp", *SENSORS)).select(
        "machine_id", *[F.col(s).alias(f"_la_{s}") for s in SENSORS])
    out = None
    for preset, (forests, feats, lags) in tree_forecasters(spark, sf).items():
        fc = recursive_tree_forecast(f, SENSORS, forests, feats, lags, steps=max(6, FUTURE_STEPS)).join(last, "machine_id", "left")
        fc = fc.select(F.lit(preset).alias("preset"), "machine_id", "step", _ntz(),
                       *[_r9(clamp_garbage(F.col(s), F.col(f"_la_{s}")), s) for s in SENSORS])
        out = fc if out is None else out.unionByName(fc)
    return out


# --- M3 with fixed forecasters, for the SQL twin: a linear one and one of two stumps per sensor, two lags
FIXED_WEIGHTS = (0.5, 0.3, 0.15, 0.05)   # now, one and two rows before, the next sensor now
FIXED_INTERCEPT = 0.75
FIXED_STUMPS = ((0, 200.0, 150.0, 260.0, 1.0), (2, 120.0, -20.0, 15.0, 0.5))  # lag, cut, left, right, weight
FIXED_LIMITS = {"Cushion": (0, 180.0), "Injection_pressure": (155.0, None)}


def fixed_forecasters():
    """Coefficients, intercepts and forests of the fixed forecasters."""
    from moldwatch.ml.trees import forest_from_nodes
    now, one, two, other = FIXED_WEIGHTS
    nxt = dict(zip(SENSORS, SENSORS[1:] + SENSORS[:1]))
    coef = {s: {s: now, f"{s}_lag_1": one, f"{s}_lag_2": two, nxt[s]: other} for s in SENSORS}
    feats = list(SENSORS) + [f"{s}_lag{k}" for k in (1, 2) for s in SENSORS]
    forests = {}
    for i, s in enumerate(SENSORS):
        nodes = []
        for t, (lag, cut, left, right, _) in enumerate(FIXED_STUMPS):
            nodes += [(t, 0, 0.0, 1, 2, i + lag * len(SENSORS), cut), (t, 1, left, -1, -1, -1, 0.0), (t, 2, right, -1, -1, -1, 0.0)]
        forests[s] = forest_from_nodes(nodes, [w for *_, w in FIXED_STUMPS])
    return coef, {s: FIXED_INTERCEPT for s in SENSORS}, forests, feats


def _fixed_sql():
    now, one, two, other = FIXED_WEIGHTS

    def clamped(s, v):
        lo, hi = FIXED_LIMITS.get(s, (None, None))
        v = f"greatest({v}, {lo}E0)" if lo else v
        return f"least({v}, {hi}E0)" if hi else v

    def linear(s, n):
        return f"{FIXED_INTERCEPT}E0 + {now}E0 * {s}_0 + {one}E0 * {s}_1 + {two}E0 * {s}_2 + {other}E0 * {n}_0"

    def stumps(s, n):
        return " + ".join(f"{w}E0 * CASE WHEN {s}_{lag} <= {cut} THEN {left}E0 ELSE {right}E0 END" for lag, cut, left, right, w in FIXED_STUMPS)

    start = ", ".join(f"coalesce(l[len(l) - {k}], l[1]).{s} AS {s}_{k}" for s in SENSORS for k in range(3))
    row = ", ".join(f"{s} := coalesce({s}, 0)" for s in SENSORS)
    ctes, parts = [f"""
fx0 AS (SELECT machine_id, max(timestamp) AS last, list(struct_pack({row}) ORDER BY timestamp) AS l FROM fw GROUP BY machine_id),
fx1 AS (SELECT machine_id, last, 0 AS step, {start} FROM fx0)"""], []
    for name, rule in (("linear", linear), ("trees", stumps)):
        step = ", ".join(f"{clamped(s, rule(s, n))} AS {s}_0, {s}_0 AS {s}_1, {s}_1 AS {s}_2" for s, n in zip(SENSORS, SENSORS[1:] + SENSORS[:1]))
        ctes.append(f"""
fr_{name} AS (SELECT * FROM fx1 UNION ALL SELECT machine_id, last, step + 1, {step} FROM fr_{name} WHERE step < {FUTURE_STEPS})""")
        cols = ", ".join(f"round({s}_0, 9) AS {s}" for s in SENSORS)
        parts.append(f"SELECT '{name}' AS model, machine_id, CAST(step AS INT) AS step, last + step * INTERVAL 1 MINUTE AS timestamp, {cols} "
                     f"FROM fr_{name} WHERE step > 0")
    text = fixture_sql(" UNION ALL ".join(parts), O.history_cte(), O.filled_window_cte(PAST_WINDOW_MIN), *ctes)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("recursive_forecast_fixed", _fixed_sql())
def q_recursive_fixed(spark, sf):
    f = filled_window(fx.history(spark, sf), SENSORS, PAST_WINDOW_MIN)
    coef, icpt, forests, feats = fixed_forecasters()
    both = [recursive_linear_forecast(f, SENSORS, coef, icpt, 2, FUTURE_STEPS, limits=FIXED_LIMITS).withColumn("model", F.lit("linear")),
            recursive_tree_forecast(f, SENSORS, forests, feats, 2, FUTURE_STEPS, limits=FIXED_LIMITS).withColumn("model", F.lit("trees"))]
    return both[0].unionByName(both[1]).select("model", "machine_id", "step", _ntz(), *[_r9(s) for s in SENSORS])
