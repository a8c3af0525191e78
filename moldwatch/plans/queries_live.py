"""Registered queries: live state, scoring and windows over a replayed stream
(step 10: L1-L7).  Each query replays readings derived from the driver
tables through the streaming operator (availableNow, bounded micro-batches)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.rolling import rolling_buffered
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.plans.queries_join import _wide_sql, wide
from moldwatch.streaming import live as L
from moldwatch.streaming import sensor_window as W

SENSORS = config.FIXTURE_SENSORS
LIVE_WINDOW_S = 6 * 3600  # fixture scale of the 5 min live window


def readings(spark, sf):
    return fx.clean(spark, sf).select("machine_id", "variable_name", "value", "timestamp",
                                      F.col("event_id").alias("seq"))


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


_STATUS_CACHE: dict = {}


def live_status(spark, sf):
    key = (sf, id(spark))
    if key not in _STATUS_CACHE:
        _STATUS_CACHE[key] = L.live_status_replay(spark, readings(spark, sf))
    return _STATUS_CACHE[key]


# --- L1 + L2: per-reading live / offline status from the keyed state ---------
def _status_sql():
    n = len(SENSORS)
    idx = range(1, n + 1)
    nb = ",\n           ".join(
        f"CASE WHEN o.variable_name = '{x}' THEN o.value ELSE r.b{i} END AS nb{i}"
        for i, x in zip(idx, SENSORS))
    ct = SENSORS.index("Cycle_time") + 1
    shared = " OR ".join(f"(nb{i} IS NOT NULL AND p{i} IS NOT NULL)" for i in idx)
    equal = " AND ".join(f"(nb{i} IS NULL OR p{i} IS NULL OR nb{i} = p{i})" for i in idx)
    offline = (f"((nb{ct} IS NOT NULL AND nb{ct} <= {L.OFFLINE_CYCLE}) OR "
               f"(hp AND ({shared}) AND {equal}))")
    bcols = ", ".join(f"nb{i}" for i in idx)
    pnew = ", ".join(f"CASE WHEN {offline} THEN p{i} ELSE nb{i} END" for i in idx)
    rcols = ", ".join(f"b{i}" for i in idx) + ", hp, " + ", ".join(f"p{i}" for i in idx)
    step = f"""
  SELECT machine_id, rn, seq, timestamp, variable_name, {bcols},
         CASE WHEN {offline} THEN hp ELSE true END, {pnew},
         CASE WHEN {offline} THEN 'offline' ELSE 'success' END
  FROM (SELECT o.machine_id, o.rn, o.seq, o.timestamp, o.variable_name,
           {nb},
           r.hp, {", ".join(f"r.p{i}" for i in idx)}
        FROM {{src}}) x"""
    first = step.replace("{src}", "ord o LEFT JOIN (SELECT NULL::VARCHAR AS machine_id, "
                         + ", ".join(f"NULL::DOUBLE AS b{i}" for i in idx) + ", false AS hp, "
                         + ", ".join(f"NULL::DOUBLE AS p{i}" for i in idx)
                         + ") r ON true WHERE o.rn = 1")
    rec = step.replace("{src}", "rec r JOIN ord o ON o.machine_id = r.machine_id AND o.rn = r.rn + 1")
    cnt = " + ".join(f"CAST(b{i} IS NOT NULL AS INT)" for i in idx)
    outs = ", ".join(f"round(b{i}, 9) AS {x}" for i, x in zip(idx, SENSORS))
    return f"""
SELECT machine_id, seq, timestamp, variable_name, {cnt} AS sensors_buffered, status, {outs}
FROM rec""", f"""
ord AS (SELECT machine_id, event_id AS seq, timestamp, variable_name, value,
               row_number() OVER (PARTITION BY machine_id ORDER BY timestamp, event_id) AS rn FROM clean),
rec(machine_id, rn, seq, timestamp, variable_name, {rcols}, status) AS ({first}
  UNION ALL{rec})"""


@register("live_status", fixture_sql(_status_sql()[0], _status_sql()[1]).replace("WITH ", "WITH RECURSIVE ", 1))
def q_live_status(spark, sf):
    s = live_status(spark, sf)
    m = F.map_from_arrays("sensor_keys", "sensor_vals")
    return s.select("machine_id", "seq", _ntz(), "variable_name", "sensors_buffered", "status",
                    *[F.round(m[x], 9).alias(x) for x in SENSORS])


# --- L5: buffer size per machine after the last reading -----------------------
@register("live_buffer_status", fixture_sql("""
SELECT machine_id, CAST(count(DISTINCT variable_name) AS INT) AS buffer_size FROM clean GROUP BY 1"""))
def q_buffer_status(spark, sf):
    return L.buffer_status(live_status(spark, sf))


@register("live_state_buffer", fixture_sql("""
SELECT machine_id, CAST(count(DISTINCT variable_name) AS INT) AS buffer_size,
       string_agg(DISTINCT variable_name, ',' ORDER BY variable_name) AS sensors FROM clean GROUP BY 1"""))
def q_state_buffer(spark, sf):
    base = L.scratch_dir(spark, "live-state")
    L.replay(spark, readings(spark, sf), L.live_status_stream, "live-state", base=base)
    b = L.state_buffer(spark, f"{base}/ckpt")
    return b.select("machine_id", "buffer_size", F.array_join("sensors", ",").alias("sensors"))


# --- L3: live scoring with the raw-sensor model ----------------------------------
def raw_sensor_model(spark, sf):
    from moldwatch.plans.training import raw_sensor_model as m
    return m(spark, sf)


@register("live_scores")
def q_live_scores(spark, sf):
    sc = L.live_scores(live_status(spark, sf), raw_sensor_model(spark, sf), SENSORS)
    return sc.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --- L4: buffered rolling features (closed window, last 1000 readings) --------
def _l4_sql(cap=1000, w_us=LIVE_WINDOW_S * 1_000_000):
    parts = []
    for s in SENSORS:
        v = f"CASE WHEN variable_name = '{s}' THEN value END"
        fr_t = f"RANGE BETWEEN {w_us} PRECEDING AND CURRENT ROW"
        fr_r = f"ROWS BETWEEN {cap - 1} PRECEDING AND CURRENT ROW"
        o_t = "PARTITION BY machine_id ORDER BY epoch_us(timestamp)"
        o_r = "PARTITION BY machine_id ORDER BY timestamp, event_id"
        n_t = f"count(*) OVER ({o_t} {fr_t})"

        def agg(fn, x=v):
            return f"CASE WHEN {n_t} <= {cap} THEN {fn}({x}) OVER ({o_t} {fr_t}) ELSE {fn}({x}) OVER ({o_r} {fr_r}) END"
        lastv = (f"CASE WHEN {n_t} <= {cap} THEN last_value({v} IGNORE NULLS) OVER ({o_t} {fr_t}) "
                 f"ELSE last_value({v} IGNORE NULLS) OVER ({o_r} {fr_r}) END")
        parts.append(f"""
SELECT machine_id, event_id AS seq, timestamp, '{s}' AS sensor,
  {agg('count')} AS n_w, {agg('avg')} AS mean_w, {agg('stddev_samp')} AS std_w, {agg('min')} AS min_w,
  {agg('max')} AS max_w, {lastv} AS last_w,
  last_value({v} IGNORE NULLS) OVER ({o_r} {fr_r}) AS fallback,
  count({v}) OVER ({o_r} {fr_r}) AS n_buf,
  count(*) OVER ({o_r} {fr_r}) AS n_rows
FROM clean""")
    return "\nUNION ALL".join(parts)


LIVE_ROLLING_SQL = fixture_sql(f"""
SELECT machine_id, seq, timestamp, sensor,
  round(CASE WHEN n_w > 0 THEN mean_w ELSE fallback END, 9) AS mean,
  round(CASE WHEN n_w > 1 THEN std_w ELSE 0.0E0 END, 9) AS std,
  round(CASE WHEN n_w > 0 THEN min_w ELSE fallback END, 9) AS min,
  round(CASE WHEN n_w > 0 THEN max_w ELSE fallback END, 9) AS max,
  round(CASE WHEN n_w > 0 THEN last_w ELSE fallback END, 9) AS last
FROM ({_l4_sql()}) t WHERE n_rows >= 3 AND n_buf > 0""")


@register("live_rolling", LIVE_ROLLING_SQL)
def q_live_rolling(spark, sf):
    out = L.replay(spark, readings(spark, sf),
                   lambda s: L.live_rolling_stream(s, window_s=LIVE_WINDOW_S, cap=1000), "live-rolling")
    return out.select("machine_id", "seq", _ntz(), "sensor",
                      *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max", "last")])


@register("rolling_buffered", LIVE_ROLLING_SQL)
def q_rolling_buffered(spark, sf):
    out = rolling_buffered(readings(spark, sf), SENSORS, LIVE_WINDOW_S, cap=1000)
    return out.select("machine_id", "seq", _ntz(), "sensor",
                      *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max", "last")])


# --- L4 with state bounded in time: frames per (machine, sensor) -----------------
@register("live_sensor_windows", fixture_sql("""
SELECT a.machine_id, a.variable_name AS sensor, a.event_id AS seq, a.timestamp, count(*) AS n,
       round(avg(b.value), 9) AS mean, round(coalesce(stddev_samp(b.value), 0.0E0), 9) AS std,
       round(min(b.value), 9) AS min, round(max(b.value), 9) AS max
FROM clean a JOIN clean b ON b.machine_id = a.machine_id AND b.variable_name = a.variable_name
  AND b.timestamp >= a.timestamp - INTERVAL 6 HOUR
  AND (b.timestamp < a.timestamp OR (b.timestamp = a.timestamp AND b.event_id <= a.event_id))
WHERE a.value IS NOT NULL AND b.value IS NOT NULL
GROUP BY a.machine_id, a.variable_name, a.event_id, a.timestamp"""))
def q_sensor_windows(spark, sf):
    with W.rocksdb_state(spark):
        out = L.replay(spark, readings(spark, sf), lambda s: W.sensor_windows(s, LIVE_WINDOW_S), "live-sensor-windows")
    return out.select("machine_id", "sensor", "seq", _ntz(), "n",
                      *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")])


# --- L7: event-time windows with a watermark -----------------------------------
@register("live_windows", fixture_sql("""
SELECT machine_id, variable_name, window_start, window_start + INTERVAL 6 HOUR AS window_end,
       count(*) AS n, round(avg(value), 9) AS mean_value, max(value) AS max_value
FROM (SELECT *, make_timestamp(CAST(floor(epoch_us(timestamp) / 21600000000) AS BIGINT) * 21600000000) AS window_start
      FROM clean) t
GROUP BY machine_id, variable_name, window_start"""))
def q_live_windows(spark, sf):
    out = L.replay(spark, readings(spark, sf),
                   lambda s: L.windowed_readings(s, "6 hours", watermark="1 day"), "live-windows", flush="2 DAYS")
    return out.select("machine_id", "variable_name", _ntz("window_start"), _ntz("window_end"), "n",
                      F.round("mean_value", 9).alias("mean_value"), "max_value")


# --- L6: history timeline + the latest live point -----------------------------
def _timeline_sql():
    sens = ", ".join(f"round({x}, 9) AS {x}" for x in SENSORS)
    live = ", ".join(f"round(max(v) FILTER (WHERE variable_name = '{x}'), 9) AS {x}" for x in SENSORS)
    return f"""
SELECT machine_id, timestamp, {sens}, false AS is_live FROM w
UNION ALL
SELECT l.machine_id, l.timestamp, {live.replace('max(v)', 'max(b.v)')}, true AS is_live
FROM (SELECT machine_id, max(timestamp) AS timestamp FROM clean GROUP BY 1) l
JOIN (SELECT machine_id, variable_name, arg_max(value, timestamp) AS v FROM clean GROUP BY 1, 2) b
  USING (machine_id)
GROUP BY l.machine_id, l.timestamp"""


@register("live_timeline", fixture_sql(_timeline_sql(), f"\nw AS ({_wide_sql()})"))
def q_live_timeline(spark, sf):
    t = L.live_append_timeline(wide(spark, sf), live_status(spark, sf), SENSORS)
    return t.select("machine_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                    *[F.round(x, 9).alias(x) for x in SENSORS], "is_live")
