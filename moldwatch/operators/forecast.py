"""Forecasting.

M1/M2 are closed-form per (machine, sensor) aggregates (``regr_slope`` /
``regr_intercept``) plus ``explode(sequence(...))`` for the future points.
M3 (recursive multi-sensor forecast) with a linear forecaster keeps the recursion inside one
expression: ``aggregate(sequence(1, steps), state, step)`` over per-machine
lag arrays with the linear forecaster's coefficients as literals, so it runs
as codegen'd JVM expressions, one row per machine.  With a forecaster of trees, Arrow batches of
machines walk the trees together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moldwatch.operators.latest import idle_by_last_rows
from moldwatch.operators.order import last_n_per_key


def trend_forecast(window_long: DataFrame, keys=("machine_id", "sensor"), ts: str = "timestamp",
                   value: str = "value", fit_minutes: float = 15, future_minutes: float = 60,
                   points: int = 10, min_points: int = 10, idle: DataFrame | None = None,
                   machine_keys=("machine_id",)) -> DataFrame:
    """Linear trend forecast (M1) with the idle override (M2).

    ``window_long``: one row per (machine, sensor, timestamp) of the history
    window (value may be NULL).  x = seconds since the machine's first
    window timestamp; OLS over rows with x >= latest - fit window (NULL
    values skipped); fewer than ``min_points`` -> no prediction.  Points:
    ``points`` values evenly from latest to latest + future, timestamps =
    last + int(offset) seconds.  ``idle`` (machine_keys, is_idle) forces the
    predictions to 0.
    Returns history rows (type 'history') and prediction rows.
    """
    keys, mkeys = list(keys), list(machine_keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = window_long.groupBy(*mkeys).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"),
                                           F.max(ts).alias("_last"))
    x = window_long.join(span, mkeys).withColumn("_x", (us - F.col("_t0")) / 1e6) \
        .withColumn("_lat", (F.col("_t1") - F.col("_t0")) / 1e6)
    rec = x.where(F.col("_x") >= F.col("_lat") - F.lit(fit_minutes * 60.0))
    fit = rec.groupBy(*keys).agg(
        F.regr_slope(value, "_x").alias("_b"), F.regr_intercept(value, "_x").alias("_a"),
        F.regr_count(value, "_x").alias("_n"), F.first("_lat").alias("_lat"),
        F.first("_last").alias("_last"))
    fit = fit.where(F.col("_n") >= min_points)
    step = future_minutes * 60.0 / (points - 1)
    pts = fit.select(*keys, "_a", "_b", "_lat", "_last",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    off = F.floor(F.col("_k") * F.lit(step)).cast("long")
    pred_v = F.col("_a") + F.col("_b") * (F.col("_lat") + F.col("_k") * F.lit(step))
    pred = pts.select(*keys, F.timestamp_micros(F.unix_micros(F.col("_last").cast("timestamp"))
                                                + off * 1_000_000).alias(ts),
                      pred_v.alias(value), F.lit("prediction").alias("type"))
    if idle is not None:
        pred = pred.join(idle.select(*mkeys, "is_idle"), mkeys, "left").withColumn(
            value, F.when(F.coalesce("is_idle", F.lit(False)), F.lit(0.0)).otherwise(F.col(value))
        ).drop("is_idle")
    hist = window_long.select(*keys, ts, value, F.lit("history").alias("type"))
    return hist.unionByName(pred)


def window_mean(window_long: DataFrame, keys=("machine_id", "sensor"), value: str = "value"
                ) -> DataFrame:
    """Mean per sensor over the window: the EMA target."""
    return window_long.groupBy(*keys).agg(F.avg(value).alias("window_mean"))


def fallback_forecast(last_values: DataFrame, means: DataFrame | None, steps: int,
                      keys=("machine_id", "sensor"), ts: str = "timestamp", alpha: float = 0.05,
                      step_seconds: int = 60) -> DataFrame:
    """Fallback future values (M4): flat carry-forward of the last value
    (``means=None``), or the EMA pull toward the window mean in closed form
    v_k = mu + (last - mu) * (1 - alpha)^k, 6 dp.  ``last_values``: keys,
    ts (last time), value."""
    x = last_values.select(*keys, ts, F.col("value").alias("_last"),
                           F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    if means is None:
        v = F.col("_last")
    else:
        x = x.join(means, list(keys), "left")
        mu = F.coalesce(F.col("window_mean"), F.col("_last"))
        v = F.round(mu + (F.col("_last") - mu) * F.pow(F.lit(1.0 - alpha), F.col("step")), 6)
    fut_ts = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp"))
                                + F.col("step") * F.lit(step_seconds * 1_000_000))
    return x.select(*keys, "step", fut_ts.alias(ts), v.alias("value"))


def clamp_garbage(value, last_actual, bound: float = 1e6) -> Column:
    """Non-finite or |v| > bound -> the last actual value (M6)."""
    v = value if isinstance(value, Column) else F.col(value)
    la = last_actual if isinstance(last_actual, Column) else F.col(last_actual)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) > bound)
    return F.when(bad, la).otherwise(v)


def recursive_linear_forecast(wide: DataFrame, sensors, coef: dict, intercept: dict, lags: int,
                              steps: int, keys=("machine_id",), ts: str = "timestamp",
                              limits: dict | None = None,
                              step_seconds: int = 60, extra: dict | None = None) -> DataFrame:
    """Recursive multi-sensor forecast (M3) with a linear forecaster.

    Per machine: the last ``lags + 1`` rows of the (filled) history -- padded
    by repeating the oldest when shorter -- form the state; each step feeds
    current + lagged values (+ held ``extra`` features) to the per-sensor
    linear model, optionally clamps to limits (a 0 / missing bound is
    skipped, as ``0.0 or x`` is x), appends the prediction and drops the
    oldest row.  ``coef[target][feature]``, feature names ``s`` and
    ``s_lag_i``.  Returns (keys, step, ts, sensor columns).
    """
    keys, n_state = list(keys), lags + 1
    packed = _packed_state(wide, sensors, lags, keys, ts)
    extra = extra or {}

    def step_fn(acc, _i):
        st = acc["state"]
        cur = F.element_at(st, -1)

        def feat(name):
            if name in extra:
                return F.lit(float(extra[name]))
            if "_lag_" in name:
                s, lag = name.rsplit("_lag_", 1)
                return F.element_at(F.element_at(st, -(int(lag) + 1)), sensors.index(s) + 1)
            return F.element_at(cur, sensors.index(name) + 1)

        nxt = []
        for s in sensors:
            v = F.lit(float(intercept.get(s, 0.0)))
            for f, w in coef[s].items():
                if w != 0.0:
                    v = v + F.lit(float(w)) * feat(f)
            if limits and s in limits:
                lo, hi = limits[s]
                if lo:
                    v = F.greatest(v, F.lit(float(lo)))
                if hi:
                    v = F.least(v, F.lit(float(hi)))
            nxt.append(v)
        new_row = F.array(*nxt)
        new_state = F.concat(F.slice(st, 2, n_state - 1), F.array(new_row))
        return F.struct(new_state.alias("state"), F.concat(acc["out"], F.array(new_row)).alias("out"))

    init = F.struct(F.col("_state").alias("state"),
                    F.array().cast("array<array<double>>").alias("out"))
    res = packed.select(*keys, "_last_ts", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init,
                                                       step_fn)["out"].alias("_out"))
    return _steps(res, sensors, keys, ts, step_seconds)


def recursive_tree_forecast(wide: DataFrame, sensors, forests: dict, features, lags: int, steps: int, keys=("machine_id",),
                            ts: str = "timestamp", limits: dict | None = None, step_seconds: int = 60,
                            extra: dict | None = None) -> DataFrame:
    """Recursive multi-sensor forecast (M3) with a forecaster of trees.

    As :func:`recursive_linear_forecast`, with ``forests[sensor]`` (``moldwatch.ml.trees``) over
    ``features``, named ``s``, ``s_lag{i}`` and those of ``extra``.  A batch holds many
    machines; each step walks every sensor's trees for all of them at once.
    """
    import numpy as np
    import pyarrow as pa

    keys, n_sensors, own = list(keys), len(sensors), dict(extra or {})
    packed = _packed_state(wide, sensors, lags, keys, ts)
    place = {s: (-1, i) for i, s in enumerate(sensors)} | {
        f"{s}_lag{k}": (-1 - k, i) for k in range(1, lags + 1) for i, s in enumerate(sensors)}
    bounds = [tuple((limits or {}).get(s, (None, None))) for s in sensors]

    def walk(batches):
        for b in batches:
            n = b.num_rows
            state = b.column("_state").flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, lags + 1, n_sensors).copy()
            out = np.zeros((n, steps, n_sensors))
            for k in range(steps):
                x = np.column_stack([state[:, place[f][0], place[f][1]] if f in place else np.full(n, float(own[f])) for f in features])
                for i, s in enumerate(sensors):
                    v = forests[s].predict(x)
                    lo, hi = bounds[i]
                    v = np.maximum(v, lo) if lo else v
                    out[:, k, i] = np.minimum(v, hi) if hi else v
                state = np.concatenate([state[:, 1:], out[:, k:k + 1]], axis=1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * steps * n_sensors + 1, n_sensors), pa.int32()), pa.array(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * steps + 1, steps), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keys] + [b.column("_last_ts"), lists], [*keys, "_last_ts", "_out"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "_state")
    return _steps(packed.mapInArrow(walk, f"{schema}, _out array<array<double>>"), sensors, keys, ts, step_seconds)


def _packed_state(wide: DataFrame, sensors, lags: int, keys, ts: str) -> DataFrame:
    """One row per key: _last_ts and _state, the sensors of the last ``lags + 1`` rows in order of time,
    padded by repeating the oldest."""
    n_state = lags + 1
    tail = last_n_per_key(wide.select(*keys, ts, *sensors), keys, ts, n_state)
    packed = tail.groupBy(*keys).agg(
        F.max(ts).alias("_last_ts"),
        F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"),
                                             *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s)
                                               for s in sensors]))).alias("_rows"))
    # bounded: lags + 1 rows
    pad = F.array_repeat(F.element_at("_rows", 1), F.greatest(F.lit(n_state) - F.size("_rows"), F.lit(0)))
    state = F.transform(F.concat(pad, F.col("_rows")), lambda r: F.array(*[r[s] for s in sensors]))
    return packed.select(*keys, "_last_ts", state.alias("_state"))


def _steps(res: DataFrame, sensors, keys, ts: str, step_seconds: int) -> DataFrame:
    """One row per key and step of the _out arrays."""
    ex = res.select(*keys, "_last_ts", F.posexplode("_out").alias("_p", "_v"))
    return ex.select(*keys, (F.col("_p") + 1).alias("step"),
                     F.timestamp_micros(F.unix_micros(F.col("_last_ts").cast("timestamp"))
                                        + (F.col("_p") + 1) * F.lit(step_seconds * 1_000_000)).alias(ts),
                     *[F.element_at("_v", i + 1).alias(s) for i, s in enumerate(sensors)])


__all__ = ["trend_forecast", "window_mean", "fallback_forecast", "clamp_garbage",
           "recursive_linear_forecast", "recursive_tree_forecast", "idle_by_last_rows"]
