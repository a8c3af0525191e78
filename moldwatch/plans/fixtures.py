"""Operator inputs derived from the driver tables (see FIXTURES.md)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moldwatch import config
from moldwatch.operators.ingest import clean_telemetry, production_events
from moldwatch.sources.tables import production_log_raw, scored_raw, telemetry_raw


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_telemetry(telemetry_raw(spark, sf))


def events(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return production_events(production_log_raw(spark, sf), **kw)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_raw(spark, sf)


def limits(spark: SparkSession) -> DataFrame:
    return config.limits_df(spark, config.FIXTURE_LIMITS)


def tolerances(spark: SparkSession) -> DataFrame:
    return config.tolerances_df(spark, config.FIXTURE_TOLERANCES)


def machines(spark: SparkSession) -> DataFrame:
    return config.machines_df(spark, config.FIXTURE_MACHINES)


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Scored wide history per machine (the dashboard's input): wide cycles
    + score of the same event, probability clipped (P17), idle rows masked
    (P16: probability and label 0)."""
    from pyspark.sql import functions as F

    from moldwatch.functions import clip_probability, is_idle
    from moldwatch.operators.latest import pivot_wide
    w = pivot_wide(clean(spark, sf), config.FIXTURE_SENSORS)
    s = scored(spark, sf).select("machine_id", "timestamp", "scrap_probability", "is_scrap_actual")
    h = w.join(s, ["machine_id", "timestamp"], "left")
    idle = is_idle("Cycle_time")
    return h.select(
        "machine_id", "timestamp", *config.FIXTURE_SENSORS,
        F.when(idle, F.lit(0.0)).otherwise(clip_probability("scrap_probability"))
        .alias("scrap_probability"),
        F.when(idle, F.lit(0)).otherwise(F.coalesce(F.col("is_scrap_actual"), F.lit(0)))
        .alias("is_scrap_actual"))
