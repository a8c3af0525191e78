"""Machine status check: latest state -> limit violations -> alert level.

One row per configured machine, all machines in one job (the reference
answers one machine per HTTP call).  Machines without readings get
LOW / NO DATA.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.operators.alerts import alert_level
from moldwatch.operators.ingest import recent_window
from moldwatch.operators.latest import latest_values
from moldwatch.operators.limits import violations


def machine_status(clean: DataFrame, scored: DataFrame, limits: DataFrame,
                   machines: DataFrame, window_minutes: float | None = None,
                   preset: str = "status") -> DataFrame:
    """clean: machine_id, timestamp, variable_name, value[, event_id];
    scored: machine_id, timestamp, scrap_probability[, event_id]."""
    src = clean if window_minutes is None else recent_window(clean, window_minutes)
    latest = latest_values(src)
    viol = violations(latest, limits)
    v_agg = viol.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_violations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("ordinal", "direction", "parameter"))), lambda e: e["parameter"]), ",")
        .alias("violated"))
    last_ts = src.groupBy("machine_id").agg(F.max("timestamp").alias("timestamp"))
    risk = scored.groupBy("machine_id").agg(
        F.max_by("scrap_probability", "timestamp").alias("ml_risk_probability"))
    m = (machines.join(last_ts, "machine_id", "left")
         .join(v_agg, "machine_id", "left").join(risk, "machine_id", "left"))
    has_data = F.col("timestamp").isNotNull()
    n = F.coalesce(F.col("n_violations"), F.lit(0))
    p = F.when(has_data, F.coalesce(F.col("ml_risk_probability"), F.lit(0.0))).otherwise(0.0)
    lvl = alert_level(n, p, preset=preset, has_data=has_data)
    return m.select(
        "machine_id",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.round(p, 9).alias("ml_risk_probability"),
        n.cast("long").alias("n_violations"),
        F.coalesce(F.col("violated"), F.lit("")).alias("violated"),
        lvl["alert_level"].alias("alert_level"),
        lvl["decision_reason"].alias("decision_reason"))
