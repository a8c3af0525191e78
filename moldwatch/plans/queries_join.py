"""Registered queries: labelling joins and pivots (step 2-3: J1-J5, A1-A4)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.asof import MINUTE_US, asof_label, asof_nearest, context_rows
from moldwatch.operators.latest import dedup_mean, max_label, pivot_wide
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql

SENSORS = config.FIXTURE_SENSORS


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _wide_sql(round_to=9):
    cols = ",\n       ".join(
        f"round(avg(value) FILTER (WHERE variable_name = '{s}'), {round_to}) AS {s}" for s in SENSORS)
    return f"SELECT machine_id, timestamp,\n       {cols}\nFROM clean GROUP BY machine_id, timestamp"


def wide(spark, sf):
    w = pivot_wide(fx.clean(spark, sf), SENSORS)
    return w.select("machine_id", "timestamp", *[F.round(s, 9).alias(s) for s in SENSORS])


_EXISTS_5 = ("EXISTS (SELECT 1 FROM prod_events e WHERE e.machine_id = c.machine_id AND "
             "e.event_ts BETWEEN c.timestamp - INTERVAL 5 MINUTE AND c.timestamp + INTERVAL 5 MINUTE)")
_EXISTS_FWD = ("EXISTS (SELECT 1 FROM prod_events e WHERE e.machine_id = c.machine_id AND "
               "e.event_ts > c.timestamp AND e.event_ts <= c.timestamp + INTERVAL 30 MINUTE)")


# --- J1 (a): nearest as-of label within 5 minutes ----------------------------
@register("asof_scrap_label", fixture_sql(f"""
SELECT c.event_id, c.machine_id, c.timestamp, c.variable_name,
       CAST(CASE WHEN {_EXISTS_5} THEN 1 ELSE 0 END AS INT) AS is_scrap
FROM clean c"""))
def q_asof_label(spark, sf):
    lab = asof_label(fx.clean(spark, sf), fx.events(spark, sf), tolerance_us=5 * MINUTE_US,
                     direction="nearest", label="is_scrap")
    return lab.select("event_id", "machine_id", _ntz(), "variable_name", "is_scrap")


# --- J1 (b): nearest event row within 5 minutes (tie -> earlier) -------------
@register("asof_nearest_event", fixture_sql("""
SELECT c.event_id, c.machine_id, c.timestamp, c.variable_name, k.event_record_id,
       k.scrap_quantity, k.event_ts AS match_ts, k.gap AS match_gap_us
FROM clean c LEFT JOIN cand k ON k.event_id = c.event_id AND k.rn = 1""", """
cand AS (
  SELECT c.event_id, e.event_record_id, e.scrap_quantity, e.event_ts,
         epoch_us(e.event_ts) - epoch_us(c.timestamp) AS gap,
         row_number() OVER (PARTITION BY c.event_id
                            ORDER BY abs(epoch_us(e.event_ts) - epoch_us(c.timestamp)), e.event_ts) AS rn
  FROM clean c JOIN prod_events e ON e.machine_id = c.machine_id
   AND e.event_ts BETWEEN c.timestamp - INTERVAL 5 MINUTE AND c.timestamp + INTERVAL 5 MINUTE)"""))
def q_asof_nearest(spark, sf):
    j = asof_nearest(fx.clean(spark, sf), fx.events(spark, sf), tolerance_us=5 * MINUTE_US,
                     payload=["event_record_id", "scrap_quantity"])
    return j.select("event_id", "machine_id", _ntz(), "variable_name", "event_record_id",
                    "scrap_quantity", _ntz("match_ts"), "match_gap_us")


# --- J2: forward interval label (ts, ts + 30 min] ------------------------------
@register("forward_scrap_label", fixture_sql(f"""
SELECT c.event_id, c.machine_id, c.timestamp, c.variable_name,
       CAST(CASE WHEN {_EXISTS_FWD} THEN 1 ELSE 0 END AS INT) AS early_scrap_risk
FROM clean c"""))
def q_forward_label(spark, sf):
    lab = asof_label(fx.clean(spark, sf), fx.events(spark, sf), tolerance_us=30 * MINUTE_US,
                     direction="forward", label="early_scrap_risk")
    return lab.select("event_id", "machine_id", _ntz(), "variable_name", "early_scrap_risk")


def forward_labelled(spark, sf):
    return asof_label(fx.clean(spark, sf), fx.events(spark, sf), tolerance_us=30 * MINUTE_US,
                      direction="forward", label="early_scrap_risk")


_FWD_CTE = f"""
fwd AS (SELECT c.*, CAST(CASE WHEN {_EXISTS_FWD} THEN 1 ELSE 0 END AS INT) AS early_scrap_risk
        FROM clean c)"""


# --- J3: context rows within +-30 min of a risky row (same machine, variable) -
@register("context_rows", fixture_sql("""
SELECT f.event_id, f.machine_id, f.timestamp, f.variable_name, f.early_scrap_risk,
       EXISTS (SELECT 1 FROM fwd r WHERE r.early_scrap_risk = 1 AND r.machine_id = f.machine_id
               AND r.variable_name = f.variable_name
               AND r.timestamp BETWEEN f.timestamp - INTERVAL 30 MINUTE AND f.timestamp + INTERVAL 30 MINUTE)
         AS in_context
FROM fwd f""", _FWD_CTE))
def q_context_rows(spark, sf):
    c = context_rows(forward_labelled(spark, sf), "early_scrap_risk", radius_us=30 * MINUTE_US)
    return c.select("event_id", "machine_id", _ntz(), "variable_name", "early_scrap_risk",
                    "in_context")


# --- A1: pivot to wide cycles (duplicates averaged) ---------------------------
@register("wide_cycles", fixture_sql(_wide_sql()))
def q_wide(spark, sf):
    return wide(spark, sf).select("machine_id", _ntz(), *SENSORS)


# --- A3: per-variable dedup mean per timestamp ---------------------------------
@register("dedup_mean", fixture_sql("""
SELECT machine_id, variable_name, timestamp, round(avg(value), 9) AS value
FROM clean GROUP BY machine_id, variable_name, timestamp"""))
def q_dedup(spark, sf):
    d = dedup_mean(fx.clean(spark, sf))
    return d.select("machine_id", "variable_name", _ntz(), F.round("value", 9).alias("value"))


# --- A4 + J5: max label per (machine, ts) attached to the wide rows ----------
@register("wide_with_labels", fixture_sql(f"""
SELECT w.*, CAST(coalesce(l.early_scrap_risk, 0) AS INT) AS early_scrap_risk
FROM ({_wide_sql()}) w
LEFT JOIN (SELECT machine_id, timestamp, max(early_scrap_risk) AS early_scrap_risk
           FROM fwd GROUP BY machine_id, timestamp) l USING (machine_id, timestamp)""", _FWD_CTE))
def q_wide_labels(spark, sf):
    labels = max_label(forward_labelled(spark, sf), label="early_scrap_risk")
    w = wide(spark, sf).join(labels, ["machine_id", "timestamp"], "left")
    return w.select("machine_id", _ntz(), *SENSORS,
                    F.coalesce("early_scrap_risk", F.lit(0)).cast("int").alias("early_scrap_risk"))


# --- J4: history x scored results on rounded keys, null-safe, right keep-first -
@register("history_scored_join", fixture_sql("""
SELECT w.machine_id, w.timestamp, w.Injection_pressure, w.Cycle_time, r.scrap_probability
FROM hist w LEFT JOIN (SELECT * FROM res WHERE rn = 1) r
  ON w.timestamp = r.timestamp
 AND round_even(w.Injection_pressure, 4) IS NOT DISTINCT FROM r.ip
 AND round_even(w.Cycle_time, 4) IS NOT DISTINCT FROM r.ct""", f"""
hist AS ({_wide_sql()})""", """
res AS (
  SELECT s.timestamp, round_even(h.Injection_pressure, 4) AS ip, round_even(h.Cycle_time, 4) AS ct,
         round(s.scrap_probability, 9) AS scrap_probability,
         row_number() OVER (PARTITION BY s.timestamp, round_even(h.Injection_pressure, 4),
                                         round_even(h.Cycle_time, 4) ORDER BY s.event_id) AS rn
  FROM scored s JOIN clean c ON c.event_id = s.event_id
  JOIN hist h ON h.machine_id = c.machine_id AND h.timestamp = c.timestamp)"""))
def q_history_scored(spark, sf):
    from moldwatch.operators.sampling import dedup_keep
    hist = wide(spark, sf)
    c = fx.clean(spark, sf).select("event_id", "machine_id", "timestamp")
    s = fx.scored(spark, sf).select("event_id", "scrap_probability")
    res = (s.join(c, "event_id").join(hist, ["machine_id", "timestamp"])
           .select("event_id", "timestamp",
                   F.bround("Injection_pressure", 4).alias("ip"),
                   F.bround("Cycle_time", 4).alias("ct"),
                   F.round("scrap_probability", 9).alias("scrap_probability")))
    res = dedup_keep(res, ["timestamp", "ip", "ct"], order=["event_id"])
    h = hist.withColumn("_ip", F.bround("Injection_pressure", 4)) \
        .withColumn("_ct", F.bround("Cycle_time", 4))
    j = h.join(res, (h["timestamp"] == res["timestamp"]) & h["_ip"].eqNullSafe(res["ip"])
               & h["_ct"].eqNullSafe(res["ct"]), "left")
    return j.select("machine_id", h["timestamp"].cast("timestamp_ntz").alias("timestamp"),
                    "Injection_pressure", "Cycle_time", "scrap_probability")
