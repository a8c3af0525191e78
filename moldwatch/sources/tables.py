"""Typed readers for the input tables.

``telemetry_raw`` / ``production_log_raw`` / ``scored_raw`` present the driver's
``events`` table in the shapes the operators consume (long raw telemetry,
production log, scored history).  Each is a projection + filter over one
parquet scan, so Catalyst prunes columns and pushes the ``event_type``
predicate into the reader.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moldwatch.session import ensure_utc

_TOOL_BY_REMAINDER = ["11", "23", "30", "33", "57"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet scan of one table (S2); a column list is a projection the
    reader prunes to."""
    ensure_utc(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events",
                      ["event_id", "ts", "user_id", "event_type", "value"]) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def _machine_no(n_machines: int):
    return (F.lit(100) + F.col("user_id") % F.lit(n_machines)).cast("string")


def telemetry_raw(spark: SparkSession, sf_dir: str, n_machines: int = 5) -> DataFrame:
    """Long raw telemetry: event_id, timestamp, machine_id, variable_name,
    value (text, some not numeric), machine_definition."""
    ev = _events(spark, sf_dir).where(F.col("event_type") != "error")
    variable = (F.when(F.col("event_id") % 89 == 0, "Scrap_counter")
                .when(F.col("event_type") == "click", "Injection_pressure")
                .when(F.col("event_type") == "view", "Cycle_time")
                .when(F.col("event_type") == "purchase", "Cushion")
                .otherwise("Cyl_tmp_z1"))
    value = F.when(F.col("event_id") % 97 == 0, F.lit("N/A")).otherwise(
        F.col("value").cast("string"))
    rem = F.col("user_id") % F.lit(5)
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOL_BY_REMAINDER]),
                        (rem + 1).cast("int"))
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("m-"), _machine_no(n_machines)).alias("machine_id"),
        variable.alias("variable_name"),
        value.alias("value"),
        F.concat(F.lit("LINE-"), _machine_no(n_machines), F.lit("-"), tool)
        .alias("machine_definition"),
    )


def production_log_raw(spark: SparkSession, sf_dir: str, n_machines: int = 5) -> DataFrame:
    """Production ("quality") log: one row per machine event."""
    ev = _events(spark, sf_dir).where(F.col("event_type") == "error")
    return ev.select(
        F.col("event_id").alias("machine_event_record_id"),
        F.concat(F.lit("M-"), _machine_no(n_machines)).alias("machine_id"),
        F.date_trunc("day", F.col("ts")).alias("machine_event_create_date"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts")))
        .cast("int").alias("machine_event_create_time"),
        F.when(F.col("event_id") % 3 == 0, 100).otherwise(200).alias("machine_status_code"),
        (F.col("event_id") % 4).cast("int").alias("scrap_quantity"),
        (F.lit(10) + F.col("event_id") % 7).cast("int").alias("yield_quantity"),
        F.col("ts").alias("event_end"),
    )


def scored_raw(spark: SparkSession, sf_dir: str, n_machines: int = 5) -> DataFrame:
    """Scored history: a score per event and the actual outcome."""
    ev = _events(spark, sf_dir)
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("M"), _machine_no(n_machines)).alias("machine_id"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("scrap_probability"),
        (F.col("event_id") % 11 == 0).cast("int").alias("is_scrap_actual"),
    )


LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide event-level table: label = returned line, four numeric features,
    ordered by (l_shipdate, l_orderkey, l_linenumber)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"]
                    + LINEITEM_FEATURES)
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
        *LINEITEM_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
