"""Cleaning and event extraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import (compact_machine_id, event_timestamp, normalize_machine_id,
                                 to_number, utc_timestamp)


def clean_telemetry(raw: DataFrame, exclude=None, keep=("event_id",)) -> DataFrame:
    """Long raw telemetry -> (machine_id, timestamp, variable_name, value DOUBLE).

    P1 value coerced (non-numeric / NaN dropped), P2 timestamp parsed (bad
    dropped), P3 machine id normalised, P11 excluded variables removed.
    ``keep`` passes extra columns through (e.g. an arrival id).
    """
    exclude = config.EXCLUDED_VARIABLES if exclude is None else exclude
    extra = [c for c in keep if c in raw.columns]
    typed = raw.schema["timestamp"].dataType.typeName().startswith("timestamp")  # then filters on it reach the scan
    ts = F.col("timestamp").cast("timestamp") if typed else utc_timestamp("timestamp")
    out = raw.select(
        *extra,
        normalize_machine_id("machine_id").alias("machine_id"),
        ts.alias("timestamp"),
        F.col("variable_name"),
        to_number("value").alias("value"),
    ).where(F.col("value").isNotNull() & F.col("timestamp").isNotNull())
    if exclude:
        out = out.where(~F.col("variable_name").isin(list(exclude)))
    return out


def production_events(log: DataFrame, status_filter: bool = True, scrap_only: bool = True,
                      use_time_offset: bool = True, statuses=None) -> DataFrame:
    """Production log -> scrap events.

    Training rule: ``scrap_quantity > 0`` and status in PRODUCTION_STATUS (the
    status filter only when the column exists); event time = create date +
    create time seconds (``use_time_offset``) else ``event_end``.
    """
    statuses = statuses or config.PRODUCTION_STATUS
    df = log
    if scrap_only:
        df = df.where(F.col("scrap_quantity") > 0)
    if status_filter and "machine_status_code" in df.columns:
        df = df.where(F.col("machine_status_code").isin(statuses))
    ts = (event_timestamp("machine_event_create_date", "machine_event_create_time")
          if use_time_offset else F.col("event_end").cast("timestamp"))
    return df.select(
        F.col("machine_event_record_id").alias("event_record_id"),
        compact_machine_id("machine_id").alias("machine_id"),
        ts.alias("event_ts"),
        F.col("scrap_quantity"),
        F.col("yield_quantity"),
        (F.col("scrap_quantity") > 0).cast("int").alias("is_scrap"),
    )


def recent_window(df: DataFrame, minutes: float, anchor_offset_minutes: float = 60.0,
                  key: str = "machine_id", ts: str = "timestamp") -> DataFrame:
    """Per-machine recent window.

    anchor = max(ts) of the machine - ``anchor_offset_minutes``; keep
    ``[anchor - minutes, anchor]`` (both inclusive).  The per-machine max is
    an aggregate joined back by key (one row per machine, broadcast by AQE),
    never collected to the driver.
    """
    anchor = (df.groupBy(key).agg(F.max(ts).alias("_max_ts"))
              .select(key, (F.col("_max_ts") - F.expr(
                  f"make_dt_interval(0, 0, 0, {anchor_offset_minutes * 60.0})"))
                      .alias("_anchor")))
    lo = F.col("_anchor") - F.expr(f"make_dt_interval(0, 0, 0, {minutes * 60.0})")
    return (df.join(anchor, key)
            .where((F.col(ts) >= lo) & (F.col(ts) <= F.col("_anchor")))
            .drop("_anchor"))


def split_by_cutoff(df: DataFrame, cutoff: str = config.TRAIN_CUTOFF,
                    ts: str = "timestamp") -> DataFrame:
    """Train/test role by a fixed cutoff: ``ts <= cutoff`` -> TRAIN (P25)."""
    return df.withColumn("split", F.when(F.col(ts) <= F.lit(cutoff).cast("timestamp"),
                                         "TRAIN").otherwise("TEST"))


def binary_label(df: DataFrame, quantity: str = "scrap_quantity", label: str = "is_scrap",
                 drop=("scrap_quantity", "yield_quantity")) -> DataFrame:
    """Label = quantity > 0; outcome columns dropped."""
    return df.withColumn(label, (F.col(quantity) > 0).cast("int")).drop(*drop)
