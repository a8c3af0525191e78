"""Monitoring compositions over the scored history: recent window ->
fill -> dynamic limits -> current row -> root causes -> risk / status.
All machines at once; every per-machine list is bounded by the number of
sensors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.operators.alerts import adjusted_risk, risk_status, root_causes
from moldwatch.operators.ingest import recent_window
from moldwatch.operators.latest import latest_row
from moldwatch.operators.limits import dynamic_limits
from moldwatch.operators.rolling import fill_forward_backward


def unpivot(wide: DataFrame, sensors, keys=("machine_id", "timestamp"),
            var: str = "variable_name", value: str = "value") -> DataFrame:
    """Wide -> long over the sensor columns (``stack`` in one projection)."""
    return wide.unpivot(list(keys), list(sensors), var, value)


def filled_window(hist: DataFrame, sensors, minutes: float, anchor_offset_minutes: float = 60.0
                  ) -> DataFrame:
    """Recent window per machine (P13) then forward/back fill inside it."""
    win = recent_window(hist, minutes, anchor_offset_minutes)
    return fill_forward_backward(win, list(sensors) + ["scrap_probability", "is_scrap_actual"])


def window_limits(filled: DataFrame, sensors, tolerances: DataFrame) -> DataFrame:
    """Dynamic limits (A10) of each machine's filled window, with the sensor
    order of the window kept as ``ordinal``."""
    lim = dynamic_limits(unpivot(filled, sensors), tolerances)
    order = F.create_map(*[x for i, s in enumerate(sensors) for x in (F.lit(s), F.lit(i))])
    return lim.withColumn("ordinal", order[F.col("sensor")])


def current_state(filled: DataFrame, sensors) -> DataFrame:
    """The last row of each window."""
    return latest_row(filled.select("machine_id", "timestamp", *sensors, "scrap_probability"))


def machine_health(filled: DataFrame, sensors, tolerances: DataFrame, top: int = 3) -> DataFrame:
    """Root causes (D6), adjusted risk and status (D7) per machine."""
    lim = window_limits(filled, sensors, tolerances)
    cur = current_state(filled, sensors)
    cur_long = unpivot(cur, sensors, keys=("machine_id",), var="sensor")
    rc = root_causes(cur_long, lim.select("machine_id", "sensor", "min_limit", "max_limit", "ordinal"),
                     top=top)
    base = cur.select("machine_id", "timestamp", F.col("scrap_probability").alias("base_risk"))
    j = base.join(rc, "machine_id", "left")
    n = F.coalesce(F.col("n_breached"), F.lit(0))
    risk = adjusted_risk("base_risk", n)
    return j.select("machine_id", "timestamp", F.coalesce("root_causes", F.lit("")).alias("root_causes"),
                    F.coalesce("breached_sensors", F.lit("")).alias("breached_sensors"),
                    n.alias("n_breached"), "base_risk", risk.alias("current_risk"),
                    risk_status(risk, n).alias("status"))
