"""Configuration dimensions.

Everything in the FIXED VALUES block must equal the published configuration of
the monitored plant (limits, labels, thresholds, sensor names); it is data,
turned into small DataFrames by the helpers below and joined by broadcast
(the tables have a fixed, tiny row count, independent of the data volume).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the plant configuration; do not edit)
# ---------------------------------------------------------------------------

# Risk thresholds on the scrap probability.
ML_THRESHOLDS = {"LOW": 0.32, "MEDIUM": 0.55, "HIGH": 0.79}

# Hard safety limits: sensor -> (min, max, unit), in configuration order.
SAFE_LIMITS = [
    ("Cushion", 0.0, 8.27, "mm"),
    ("Cycle_time", 0.0, 30.68, "s"),
    ("Cyl_tmp_z1", 0.0, 572.1, "°C"),
    ("Cyl_tmp_z3", 0.0, 563.1, "°C"),
    ("Cyl_tmp_z4", 0.0, 554.3, "°C"),
    ("Cyl_tmp_z5", 0.0, 545.2, "°C"),
    ("Cyl_tmp_z8", 0.0, 175.3, "°C"),
    ("Dosage_time", 0.0, 4.22, "s"),
    ("Injection_pressure", 0.0, 1919.0, "bar"),
    ("Injection_time", 0.0, 0.62, "s"),
    ("Peak_pressure_position", 0.0, 16.48, "mm"),
    ("Peak_pressure_time", 0.0, 0.58, "s"),
    ("Switch_position", 0.0, 10.0, "mm"),
    ("Switch_pressure", 0.0, 1905.0, "bar"),
    ("Extruder_torque", -1.0, 1.0, "Nm"),
]

# Human-readable sensor labels.
PARAMETER_LABELS = [
    ("Cushion", "Cushion Position"),
    ("Cycle_time", "Cycle Time"),
    ("Cyl_tmp_z1", "Cylinder Temp Zone 1"),
    ("Cyl_tmp_z3", "Cylinder Temp Zone 3"),
    ("Cyl_tmp_z4", "Cylinder Temp Zone 4"),
    ("Cyl_tmp_z5", "Cylinder Temp Zone 5"),
    ("Cyl_tmp_z8", "Cylinder Temp Zone 8"),
    ("Dosage_time", "Dosage Time"),
    ("Ejector_fix_deviation_torque", "Ejector Torque Deviation"),
    ("Extruder_start_position", "Extruder Start Pos"),
    ("Extruder_torque", "Extruder Torque"),
    ("Injection_pressure", "Injection Pressure"),
    ("Injection_time", "Injection Time"),
    ("Peak_pressure_position", "Peak Pressure Position"),
    ("Peak_pressure_time", "Peak Pressure Time"),
    ("Scrap_counter", "Scrap Counter"),
    ("Shot_counter", "Shot Counter"),
    ("Shot_size", "Shot Size"),
    ("Switch_position", "Switch Over Position"),
    ("Switch_pressure", "Switch Over Pressure"),
]

# Process sensors used for rolling features (21).
SENSORS = [
    "Cushion", "Cycle_time", "Cyl_tmp_z1", "Cyl_tmp_z2", "Cyl_tmp_z3", "Cyl_tmp_z4",
    "Cyl_tmp_z5", "Cyl_tmp_z6", "Cyl_tmp_z7", "Cyl_tmp_z8", "Dosage_time",
    "Ejector_fix_deviation_torque", "Extruder_start_position", "Extruder_torque",
    "Injection_pressure", "Injection_time", "Peak_pressure_position",
    "Peak_pressure_time", "Shot_size", "Switch_position", "Switch_pressure",
]

# Variables that leak the label or are not process related.
EXCLUDED_VARIABLES = ["Scrap_counter", "Shot_counter", "Time_on_machine",
                      "Machine_status", "Alrams_array"]

# Columns never treated as sensors by the dynamic limits.
NON_SENSOR_COLUMNS = ["Machine_status", "Scrap_counter", "Shot_counter", "Shot_size",
                      "Time_on_machine", "Alrams_array", "scrap_probability",
                      "is_scrap_actual", "predicted_scrap", "machine_id_normalized"]

# Leakage prefixes removed from the training feature set.
LEAKAGE_PREFIXES = ["Scrap_counter", "Shot_counter", "Time_on_machine"]

# Category encodings: column -> [(value, code)].
ENCODINGS = {
    "tool_id": [("11", 0), ("23", 1), ("30", 2), ("33", 3), ("57", 4)],
    "part_number": [("UNKNOWN", 0)],
    "machine_id": [("M231", 0), ("M356", 1), ("M471", 2), ("M607", 3), ("M612", 4)],
}

# Rolling windows of the feature schema: name -> (seconds, rows, min_periods by rows).
ROLLING_WINDOWS = [("5m", 300, 30), ("15m", 900, 90), ("30m", 1800, 180)]
ROLLING_STATS = ["mean", "std", "min", "max", "last"]

# Production status code of a running cycle and the train/test cutoff.
PRODUCTION_STATUS = [200]
TRAIN_CUTOFF = "2026-01-11 23:59:59"

# Sensors whose lower limit may be negative (name contains one of these).
SIGNED_KEYWORDS = ["deviation", "offset", "tmp"]

# Boosted-tree parameter sets: rounds, learning rate, leaves, smallest leaf, class-weight cap,
# rounds without gain before stopping.  All: column and row share 0.8, L1 = L2 = 0.1.
BOOSTING_PRESETS = {
    "retrain_v2": (500, 0.05, 31, 20, 40, 50),
    "retrain_v1_2e": (500, 0.05, 63, 10, 50, 50),
    "retrain_v1_2d": (500, 0.05, 31, 10, 30, 50),
    "build_v1_2b": (1000, 0.02, 64, 50, 50, 30),
    "wide_v1_1": (500, 0.05, 64, 20, 100, 50),
    "wide": (500, 0.05, 64, 20, None, 50),
}
BOOSTING_SHARE, BOOSTING_L1, BOOSTING_L2 = 0.8, 0.1, 0.1
# Tree forecasters: trees, learning rate, depth, lags.
FORECASTER_PRESETS = {"lagged": (100, 0.05, 7, 5), "simple": (100, 0.05, 5, 3)}

# Alert presets: (threshold, level), the highest first.
ALERT_PRESETS = {
    "decision": [(0.7, "HIGH"), (0.4, "MEDIUM")],
    "live": [(0.6, "HIGH"), (0.3, "MEDIUM")],
}

# ---------------------------------------------------------------------------
# Fixture configuration for the driver tables (values scaled to 0.01..490).
# ---------------------------------------------------------------------------
FIXTURE_LIMITS = [
    ("Injection_pressure", 0.0, 100.0, "bar"),
    ("Cycle_time", 5.0, 120.0, "s"),
    ("Cushion", 0.0, 90.0, "mm"),
    ("Cyl_tmp_z1", 2.0, 150.0, "°C"),
]
FIXTURE_TOLERANCES = [
    ("Injection_pressure", 20.0, 20.0),
    ("Cushion", 15.0, 10.0),
    ("Cycle_time", None, None),
    ("Cyl_tmp_z1", None, None),
]
FIXTURE_MACHINES = ["M100", "M101", "M102", "M103", "M104", "M199"]
FIXTURE_SENSORS = ["Cushion", "Cycle_time", "Cyl_tmp_z1", "Injection_pressure"]
# Fixture rolling windows (sparse data): name -> seconds.
FIXTURE_WINDOWS = [("6h", 6 * 3600), ("1d", 86400), ("3d", 3 * 86400)]


LIMITS_SCHEMA = T.StructType([
    T.StructField("sensor", T.StringType(), False),
    T.StructField("min_limit", T.DoubleType(), True),
    T.StructField("max_limit", T.DoubleType(), True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("ordinal", T.IntegerType(), False),
])


def limits_df(spark: SparkSession, limits=None) -> DataFrame:
    """Limits dimension with its configuration order (``ordinal``) kept."""
    rows = [(s, lo, hi, u, i) for i, (s, lo, hi, u) in enumerate(limits or SAFE_LIMITS)]
    return spark.createDataFrame(rows, LIMITS_SCHEMA)


def tolerances_df(spark: SparkSession, tolerances=None) -> DataFrame:
    schema = "variable_name string, tolerance_plus double, tolerance_minus double"
    return spark.createDataFrame(list(tolerances or FIXTURE_TOLERANCES), schema)


def labels_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMETER_LABELS, "sensor string, label string")


def machines_df(spark: SparkSession, machines=None) -> DataFrame:
    return spark.createDataFrame([(m,) for m in (machines or FIXTURE_MACHINES)],
                                 "machine_id string")


def encodings_df(spark: SparkSession, encodings=None) -> DataFrame:
    rows = [(c, v, code) for c, pairs in (encodings or ENCODINGS).items() for v, code in pairs]
    return spark.createDataFrame(rows, "column string, value string, code int")
