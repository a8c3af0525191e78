"""Registered queries: rolling / pattern / fill / lag windows, encodings
(steps 3-4: W1-W14, A11, A27, E1-E3, J7, U4, P20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.encode import apply_encoding, encode_with_map, fit_label_encoding, machine_context
from moldwatch.operators.latest import dedup_mean, idle_by_last_rows, latest_row, latest_values
from moldwatch.operators.pattern import pattern_features
from moldwatch.operators.rolling import (STATS, fill_forward_backward, lag_features,
                                         rolling_live, rolling_rows_wide, rolling_serving,
                                         rolling_time_long)
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.plans.queries_join import _wide_sql, wide
from moldwatch.sources.tables import telemetry_raw

SENSORS = config.FIXTURE_SENSORS
WINDOWS = config.FIXTURE_WINDOWS
ROW_WINDOWS = [(name, n) for name, _, n in config.ROLLING_WINDOWS]


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _r9(cols):
    return [F.round(c, 9).alias(c) for c in cols]


def _agg_sql(fn, x, frame, part="machine_id", order="epoch_us(timestamp)"):
    return f"{fn}({x}) OVER (PARTITION BY {part} ORDER BY {order} {frame})"


# --- W2: time rolling, long form ---------------------------------------------
def _w2_sql(rounded=True):
    r = (lambda x: f"round({x}, 9)") if rounded else (lambda x: x)
    parts = []
    for name, secs in WINDOWS:
        fr = f"RANGE BETWEEN {secs * 1_000_000 - 1} PRECEDING AND CURRENT ROW"
        p = "machine_id, variable_name"
        ok = f"{_agg_sql('count', 'value', fr, p)} >= 3"
        parts.append(f"""
SELECT machine_id, variable_name, '{name}' AS window, timestamp,
  CASE WHEN {ok} THEN {r(_agg_sql('avg', 'value', fr, p))} END AS mean,
  CASE WHEN {ok} THEN {r(_agg_sql('stddev_samp', 'value', fr, p))} END AS std,
  CASE WHEN {ok} THEN {r(_agg_sql('min', 'value', fr, p))} END AS min,
  CASE WHEN {ok} THEN {r(_agg_sql('max', 'value', fr, p))} END AS max,
  CASE WHEN {ok} THEN {r('value')} END AS last
FROM clean""")
    return "\nUNION ALL".join(parts)


@register("rolling_time", fixture_sql(_w2_sql()))
def q_rolling_time(spark, sf):
    r = rolling_time_long(fx.clean(spark, sf), WINDOWS, min_periods=3)
    return r.select("machine_id", "variable_name", "window", _ntz(), *_r9(STATS))


# --- W2 as published: 5 / 15 / 30 minutes, at least 20 readings ----------------
# The readings are sparse, so time runs 400 times as fast here.
FASTER = 400
PUBLISHED = [(name, secs) for name, secs, _ in config.ROLLING_WINDOWS]


def _published_sql():
    parts = []
    for name, secs in PUBLISHED:
        fr = f"RANGE BETWEEN {secs * 1_000_000 - 1} PRECEDING AND CURRENT ROW"
        agg = {st: _agg_sql(fn, "value", fr, "machine_id, variable_name", "t")
               for st, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
        ok = f"{_agg_sql('count', 'value', fr, 'machine_id, variable_name', 't')} >= 20"
        parts.append(f"""
SELECT machine_id, variable_name, '{name}' AS window, make_timestamp(t) AS timestamp,
  {", ".join(f"CASE WHEN {ok} THEN round({x}, 9) END AS {st}" for st, x in agg.items())},
  CASE WHEN {ok} THEN round(value, 9) END AS last
FROM fast""")
    return ("\nUNION ALL".join(parts), f"""
fast AS (SELECT machine_id, variable_name, epoch_us(timestamp) // {FASTER} AS t, avg(value) AS value
         FROM clean GROUP BY machine_id, variable_name, epoch_us(timestamp) // {FASTER})""")


@register("rolling_published", fixture_sql(*_published_sql()))
def q_rolling_published(spark, sf):
    fast = F.timestamp_micros(F.floor(F.unix_micros("timestamp") / FASTER).cast("long"))
    c = fx.clean(spark, sf).select("machine_id", "variable_name", fast.alias("timestamp"), "value")
    r = rolling_time_long(dedup_mean(c), PUBLISHED, min_periods=20)
    return r.select("machine_id", "variable_name", "window", _ntz(), *_r9(STATS))


# --- W1: row-count rolling on the wide table ----------------------------------
def _w1_sql():
    cols = []
    for s in SENSORS:
        for name, n in ROW_WINDOWS:
            fr = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
            ok = f"{_agg_sql('count', s, fr, order='timestamp')} >= {max(3, n // 10)}"
            for st, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                cols.append(f"CASE WHEN {ok} THEN round({_agg_sql(fn, s, fr, order='timestamp')}, 9) END"
                            f" AS {s}__{st}_{name}")
            cols.append(f"CASE WHEN {ok} THEN {s} END AS {s}__last_{name}")
    return f"SELECT machine_id, timestamp,\n  " + ",\n  ".join(cols) + "\nFROM w"


def _w1_cols():
    return [f"{s}__{st}_{name}" for s in SENSORS for name, _ in ROW_WINDOWS for st in STATS]


@register("rolling_rows", fixture_sql(_w1_sql(), f"\nw AS ({_wide_sql()})"))
def q_rolling_rows(spark, sf):
    r = rolling_rows_wide(wide(spark, sf), SENSORS, ROW_WINDOWS)
    return r.select("machine_id", _ntz(), *_r9(_w1_cols()))


# --- W10 + W3: forward/back fill, then serving-time rolling --------------------
def _filled_sql():
    cols = ",\n  ".join(
        f"coalesce(last_value({s} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY timestamp "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({s} IGNORE NULLS) OVER "
        f"(PARTITION BY machine_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {s}"
        for s in SENSORS)
    return f"\nw AS ({_wide_sql()}),\nfilled AS (SELECT machine_id, timestamp,\n  {cols}\nFROM w)"


@register("fill_forward_backward", fixture_sql(
    "SELECT machine_id, timestamp, " + ", ".join(SENSORS) + " FROM filled", _filled_sql()))
def q_fill(spark, sf):
    f = fill_forward_backward(wide(spark, sf), SENSORS)
    return f.select("machine_id", _ntz(), *SENSORS)


def _w3_sql():
    cols = []
    for s in SENSORS:
        for name, secs in WINDOWS:
            fr = f"RANGE BETWEEN {secs * 1_000_000 - 1} PRECEDING AND CURRENT ROW"
            ok = f"{_agg_sql('count', s, fr)} >= 1"
            for st, fn in (("mean", "avg"), ("min", "min"), ("max", "max")):
                cols.append(f"CASE WHEN {ok} THEN round({_agg_sql(fn, s, fr)}, 9) END AS {s}__{st}_{name}")
            cols.append(f"CASE WHEN {ok} THEN round(coalesce({_agg_sql('stddev_samp', s, fr)}, 0), 9) END"
                        f" AS {s}__std_{name}")
            cols.append(f"CASE WHEN {ok} THEN {s} END AS {s}__last_{name}")
    return "SELECT machine_id, timestamp,\n  " + ",\n  ".join(cols) + "\nFROM filled"


def _wt_cols():
    return [f"{s}__{st}_{name}" for s in SENSORS for name, _ in WINDOWS for st in STATS]


@register("rolling_serving", fixture_sql(_w3_sql(), _filled_sql()))
def q_rolling_serving(spark, sf):
    r = rolling_serving(wide(spark, sf), SENSORS, WINDOWS)
    return r.select("machine_id", _ntz(), *_r9(_wt_cols()))


# --- W4: live rolling, closed frame, capped buffer ----------------------------
LIVE_WINDOW = ("6h", 6 * 3600)


def _w4_sql(cap=1000):
    name, secs = LIVE_WINDOW
    fr_t = f"RANGE BETWEEN {secs * 1_000_000} PRECEDING AND CURRENT ROW"
    fr_r = f"ROWS BETWEEN {cap - 1} PRECEDING AND CURRENT ROW"
    n_t = _agg_sql("count", "1", fr_t)
    use_t = f"({n_t} <= {cap})"

    def pick(fn, s):
        return (f"CASE WHEN {use_t} THEN {_agg_sql(fn, s, fr_t)} "
                f"ELSE {_agg_sql(fn, s, fr_r, order='timestamp')} END")

    def last(s):
        return (f"CASE WHEN {use_t} THEN last_value({s} IGNORE NULLS) OVER (PARTITION BY machine_id "
                f"ORDER BY epoch_us(timestamp) {fr_t}) ELSE last_value({s} IGNORE NULLS) OVER "
                f"(PARTITION BY machine_id ORDER BY timestamp {fr_r}) END")

    n_rows = f"least({n_t}, {cap})"
    cols = [f"CAST({n_rows} AS BIGINT) AS frame_rows"]
    for s in SENSORS:
        en = f"{n_rows} >= 3"
        cols += [f"CASE WHEN {en} THEN round({pick('avg', s)}, 9) END AS {s}__mean_{name}",
                 f"CASE WHEN {en} THEN round(coalesce({pick('stddev_samp', s)}, CASE WHEN {pick('count', s)} >= 1 "
                 f"THEN 0.0E0 END), 9) END AS {s}__std_{name}",
                 f"CASE WHEN {en} THEN round({pick('min', s)}, 9) END AS {s}__min_{name}",
                 f"CASE WHEN {en} THEN round({pick('max', s)}, 9) END AS {s}__max_{name}",
                 f"CASE WHEN {en} THEN round({last(s)}, 9) END AS {s}__last_{name}"]
    return "SELECT machine_id, timestamp,\n  " + ",\n  ".join(cols) + "\nFROM w"


@register("rolling_live", fixture_sql(_w4_sql(), f"\nw AS ({_wide_sql()})"))
def q_rolling_live(spark, sf):
    name, secs = LIVE_WINDOW
    r = rolling_live(wide(spark, sf), SENSORS, secs, name=name, cap=1000)
    cols = [f"{s}__{st}_{name}" for s in SENSORS for st in STATS]
    return r.select("machine_id", _ntz(), "frame_rows", *_r9(cols))


# --- W5-W8 + A11: pattern features with the global stability threshold --------
def _pattern_sql(n=10):
    fr = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    cols, ks, thr = [], [], []
    for s in SENSORS:
        ks.append(f"count({s}) OVER (PARTITION BY machine_id ORDER BY timestamp ROWS BETWEEN "
                  f"UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS k_{s}")
        ok = f"count({s}) OVER (PARTITION BY machine_id ORDER BY timestamp {fr}) >= 3"
        std = f"CASE WHEN {ok} THEN stddev_samp({s}) OVER (PARTITION BY machine_id ORDER BY timestamp {fr}) END"
        mean = f"CASE WHEN {ok} THEN avg({s}) OVER (PARTITION BY machine_id ORDER BY timestamp {fr}) END"
        slope = (f"CASE WHEN {ok} THEN regr_slope({s}, k_{s}) OVER (PARTITION BY machine_id "
                 f"ORDER BY timestamp {fr}) END")
        cols += [f"{std} AS {s}__pstd_{n}", f"{mean} AS {s}__pmean_{n}", f"{slope} AS {s}__ptrend_{n}",
                 f"({s} - {mean}) / (abs({mean}) + 1e-6) AS {s}__pdev_{n}"]
        thr.append(f"(SELECT quantile_cont({s}__pstd_{n}, 0.75) FROM p) AS thr_{s}")
    outs = []
    for s in SENSORS:
        for k in ("pstd", "pmean", "ptrend", "pdev"):
            outs.append(f"round(coalesce({s}__{k}_{n}, 0), 9) AS {s}__{k}_{n}")
        outs.append(f"CAST(coalesce({s}__pstd_{n} < (SELECT quantile_cont({s}__pstd_{n}, 0.75) FROM p), "
                    f"false) AS INT) AS {s}__is_stable")
    return ("SELECT machine_id, timestamp, " + ", ".join(outs) + " FROM p",
            f"\nw AS ({_wide_sql()}),\nwk AS (SELECT *, " + ", ".join(ks) + " FROM w),"
            "\np AS (SELECT machine_id, timestamp, " + ", ".join(cols) + " FROM wk)")


@register("pattern_features", fixture_sql(*_pattern_sql()))
def q_pattern(spark, sf):
    p = pattern_features(wide(spark, sf), SENSORS, stability=True)
    cols = [f"{s}__{k}_10" for s in SENSORS for k in ("pstd", "pmean", "ptrend", "pdev")]
    return p.select("machine_id", _ntz(), *_r9(cols),
                    *[F.col(f"{s}__is_stable") for s in SENSORS])


# --- W11: lags 1..3 + next-value target per machine ---------------------------
def _lag_sql(k=3):
    cols = []
    for s in SENSORS:
        cols.append(s)
        cols += [f"lag({s}, {i}) OVER (PARTITION BY machine_id ORDER BY timestamp) AS {s}_lag{i}"
                 for i in range(1, k + 1)]
        cols.append(f"lead({s}, 1) OVER (PARTITION BY machine_id ORDER BY timestamp) AS {s}_next")
    names = [c.split(" AS ")[-1] for c in cols]
    return (f"SELECT * FROM (SELECT machine_id, timestamp, {', '.join(cols)} FROM filled) t "
            f"WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names), _filled_sql())


@register("forecast_lags", fixture_sql(*_lag_sql()))
def q_lags(spark, sf):
    filled = fill_forward_backward(wide(spark, sf), SENSORS)
    lg = lag_features(filled, SENSORS, 3)
    return lg.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --- W12: latest full wide row per machine ------------------------------------
@register("latest_row", fixture_sql(
    "SELECT machine_id, arg_max(timestamp, timestamp) AS timestamp, "
    + ", ".join(f"arg_max({s}, timestamp) AS {s}" for s in SENSORS)
    + " FROM filled GROUP BY machine_id", _filled_sql()))
def q_latest_row(spark, sf):
    filled = fill_forward_backward(wide(spark, sf), SENSORS)
    r = latest_row(filled)
    return r.select("machine_id", _ntz(), *SENSORS)


# --- W13: running latest value per (machine, sensor) --------------------------
@register("latest_values", fixture_sql("""
SELECT machine_id, variable_name, round(arg_max(value, timestamp), 9) AS value, max(timestamp) AS timestamp
FROM clean GROUP BY machine_id, variable_name"""))
def q_latest_values(spark, sf):
    lv = latest_values(fx.clean(spark, sf))
    return lv.select("machine_id", "variable_name", F.round("value", 9).alias("value"), _ntz())


# --- W14: idleness from Cycle_time in the last 5 rows of the wide history ---
@register("idle_check", fixture_sql("""
SELECT machine_id, round(avg(Cycle_time), 9) AS last_mean, count(Cycle_time) AS n_values,
       (count(Cycle_time) = 0 OR coalesce(avg(Cycle_time), 0) < 0.5) AS is_idle
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY timestamp DESC) AS rn FROM w) t
WHERE rn <= 5 GROUP BY machine_id""", f"\nw AS ({_wide_sql()})"))
def q_idle(spark, sf):
    i = idle_by_last_rows(wide(spark, sf))
    return i.select("machine_id", F.round("last_mean", 9).alias("last_mean"), "n_values", "is_idle")


# --- E2 + P6 + E1 + J7: machine context and encodings --------------------------
@register("machine_context", fixture_sql("""
SELECT machine_id, machine_definition, tool_id, part_number,
       CAST(dense_rank() OVER (ORDER BY tool_id) - 1 AS INT) AS tool_id_encoded,
       CAST(coalesce(fixed.code, 0) AS INT) AS tool_id_fixed_code
FROM (
  SELECT machine_id, machine_definition,
         CASE WHEN machine_definition IS NULL OR trim(machine_definition) = '' THEN 'UNKNOWN'
              WHEN regexp_matches(machine_definition, '-([A-Za-z0-9]+)$')
                THEN regexp_extract(machine_definition, '-([A-Za-z0-9]+)$', 1)
              ELSE machine_definition END AS tool_id,
         'UNKNOWN' AS part_number
  FROM (SELECT CASE WHEN starts_with(c, 'M') THEN c ELSE 'M' || c END AS machine_id,
               arg_min(machine_definition, timestamp) FILTER (WHERE machine_definition IS NOT NULL)
                 AS machine_definition
        FROM (SELECT *, upper(regexp_replace(coalesce(machine_id, ''), '[^A-Za-z0-9]', '', 'g')) AS c
              FROM telemetry) t GROUP BY 1) d) x
LEFT JOIN (SELECT * FROM (VALUES ('11', 0), ('23', 1), ('30', 2), ('33', 3), ('57', 4)) AS v(value, code)) fixed
  ON fixed.value = x.tool_id"""))
def q_machine_context(spark, sf):
    from moldwatch.functions import normalize_machine_id
    raw = telemetry_raw(spark, sf).withColumn("machine_id", normalize_machine_id("machine_id"))
    ctx = machine_context(raw)
    fitted = fit_label_encoding(ctx, "tool_id")
    out = apply_encoding(ctx, fitted, "tool_id", broadcast_dim=False)
    out = encode_with_map(out, "tool_id", config.ENCODINGS["tool_id"], out="tool_id_fixed_code")
    return out.select("machine_id", "machine_definition", "tool_id", "part_number",
                      "tool_id_encoded", "tool_id_fixed_code")
