"""Registered queries: sources and sinks round trips and the master schema
(S1, S3, S6, S7, S8, S10, S11, A27)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import normalize_machine_id
from moldwatch.operators.encode import fit_label_encoding, machine_context
from moldwatch.operators.ingest import clean_telemetry
from moldwatch.operators.sampling import temporal_split
from moldwatch.plans import fixtures as fx
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql, history_cte
from moldwatch.sources import files as S
from moldwatch.sources import history as H
from moldwatch.sources.tables import production_log_raw, read_table, telemetry_raw
from moldwatch.streaming.live import scratch_dir


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


# --- S8 -> S1: per-machine CSV telemetry written and scanned back -----------
@register("csv_telemetry_scan", fixture_sql("""
SELECT event_id, machine_id, timestamp, variable_name, round(value, 9) AS value FROM clean"""))
def q_csv_scan(spark, sf):
    path = scratch_dir(spark, "csv-telemetry")
    raw = telemetry_raw(spark, sf)
    out = raw.select(F.upper(F.regexp_replace("machine_id", "-", "")).alias("machine_id"),
                     F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                     "variable_name", "value", "machine_definition", "event_id")
    S.write_per_machine_csv(out, path)
    schema = S.RAW_TELEMETRY_SCHEMA.add("event_id", "long")
    back = S.read_telemetry_csv(spark, path, schema)
    c = clean_telemetry(back)
    return c.select("event_id", "machine_id", _ntz(), "variable_name", F.round("value", 9).alias("value"))


# --- A17: coverage of CSV files whose columns differ from file to file -------
@register("source_coverage_files", fixture_sql("""
SELECT machine_id, CASE WHEN machine_id IN ('M100', 'M101') THEN 3 ELSE 4 END AS n_columns,
       CASE WHEN machine_id IN ('M100', 'M101') THEN 'value,event_id,Sample Time'
            ELSE 'timestamp,variable_name,value,event_id' END AS columns,
       min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows
FROM (SELECT 'M' || CAST(100 + user_id % 5 AS VARCHAR(10)) AS machine_id, ts FROM events) e GROUP BY 1"""))
def q_source_coverage_files(spark, sf):
    path = scratch_dir(spark, "csv-coverage")
    machine = F.concat(F.lit("M"), (F.lit(100) + F.col("user_id") % 5).cast("string"))
    rows = read_table(spark, sf, "events").select(
        machine.alias("machine_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("event_type").alias("variable_name"), "value", "event_id")
    old = F.col("machine_id").isin("M100", "M101")
    S.write_per_machine_csv(rows.where(~old), f"{path}/new")
    S.write_per_machine_csv(rows.where(old).select("machine_id", "value", "event_id", F.col("timestamp").alias("Sample Time")),
                            f"{path}/old")
    files = S.csv_file_coverage(spark, path)
    c = files.groupBy(F.substring_index("source_file", "-", 1).alias("machine_id"), "n_columns",
                      F.array_join("columns", ",").alias("columns")).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("rows").alias("rows"))
    return c.select("machine_id", "n_columns", "columns", _ntz("first_ts"), _ntz("last_ts"), "rows")


# --- S3: production-log export with padded headers and a lock file ---------
@register("production_log_scan", fixture_sql("""
SELECT machine_event_record_id, machine_id, machine_event_create_date, machine_event_create_time,
       machine_status_code, scrap_quantity, yield_quantity, event_end FROM production_log"""))
def q_log_scan(spark, sf):
    path = scratch_dir(spark, "hydra-export")
    log = production_log_raw(spark, sf)
    padded = log.select(*[F.col(c).cast("string").alias(f" {c} ") for c in log.columns])
    padded.write.mode("overwrite").option("header", True).csv(f"{path}/export")
    # an office lock file next to the export must be skipped
    padded.limit(1).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/lock")
    fs, lock = S._fs(spark, f"{path}/lock")
    jvm = spark.sparkContext._jvm
    for st in fs.listStatus(lock):
        if st.getPath().getName().endswith(".csv"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/export/~$lock.csv"))
    back = S.typed_production_log(S.read_production_log(spark, f"{path}/export"))
    return back.select("machine_event_record_id", "machine_id", _ntz("machine_event_create_date"),
                       "machine_event_create_time", "machine_status_code", "scrap_quantity",
                       "yield_quantity", _ntz("event_end"))


# --- S6: fitted encodings as a JSON dimension, written and read back --------
@register("encodings_json", fixture_sql("""
SELECT 'tool_id' AS "column", tool_id AS value, CAST(dense_rank() OVER (ORDER BY tool_id) - 1 AS INT) AS code
FROM (SELECT DISTINCT regexp_extract(machine_definition, '-([A-Za-z0-9]+)$', 1) AS tool_id FROM telemetry) t"""))
def q_encodings_json(spark, sf):
    path = scratch_dir(spark, "encodings")
    raw = telemetry_raw(spark, sf).withColumn("machine_id", normalize_machine_id("machine_id"))
    enc = fit_label_encoding(machine_context(raw), "tool_id")
    S.write_json_dimension(enc, path)
    return S.read_json_dimension(spark, path, "column string, value string, code int")


# --- S7 + S10 + S11: scored history partitioned by machine and split --------
@register("partitioned_history", fixture_sql("""
SELECT machine_id, split, timestamp, round(scrap_probability, 9) AS scrap_probability, is_scrap_actual
FROM sp""", history_cte(),
    """
sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, machine_id) - 1
                           < floor(count(*) OVER () * 0.8) THEN 'TRAIN' ELSE 'TEST' END AS split
       FROM hist)"""))
def q_partitioned(spark, sf):
    path = scratch_dir(spark, "history-layout")
    h = temporal_split(fx.history(spark, sf), ["timestamp", "machine_id"])
    S.write_partitioned(h.select("machine_id", "split", "timestamp", "scrap_probability", "is_scrap_actual"),
                        path, ("machine_id", "split"))
    back = spark.read.parquet(path)
    return back.select("machine_id", "split", _ntz(), F.round("scrap_probability", 9).alias("scrap_probability"),
                       "is_scrap_actual")


# --- A27: master feature schema from all distinct variables -----------------
def _master_sql():
    wins = " UNION ALL ".join(f"SELECT '{w}' AS w, {i} AS wi" for i, (w, *_r) in enumerate(config.ROLLING_WINDOWS))
    stats = " UNION ALL ".join(f"SELECT '{s}' AS st, {i} AS si" for i, s in enumerate(config.ROLLING_STATS))
    return f"""
SELECT v.variable_name || '__' || s.st || '_' || w.w AS feature,
       CAST(row_number() OVER (ORDER BY v.variable_name, w.wi, s.si) - 1 AS INT) AS position
FROM (SELECT DISTINCT variable_name FROM clean) v, ({wins}) w, ({stats}) s"""


@register("master_schema", fixture_sql(_master_sql()))
def q_master_schema(spark, sf):
    from moldwatch.operators.rolling import master_schema
    return master_schema(fx.clean(spark, sf), config.ROLLING_WINDOWS, config.ROLLING_STATS)


# --- S7 + S10: history by machine and day, appended in parts, a part of it twice -
HISTORY_COLUMNS = ["machine_id", "timestamp", *config.FIXTURE_SENSORS, "scrap_probability", "is_scrap_actual"]


def _kept_history(spark, sf):
    """The scored history written in two runs that share their days: odd days, all days again."""
    path = scratch_dir(spark, "history-days")
    h = fx.history(spark, sf).select(*HISTORY_COLUMNS)
    H.append(h.where(F.dayofmonth("timestamp") % 2 == 1), path)
    H.append(h, path)
    return path


@register("history_append", fixture_sql(f"""
SELECT machine_id, timestamp, {", ".join(f"round({s}, 9) AS {s}" for s in config.FIXTURE_SENSORS)},
       round(scrap_probability, 9) AS scrap_probability, is_scrap_actual FROM hist""", history_cte()))
def q_history_append(spark, sf):
    back = H.read(spark, _kept_history(spark, sf))
    return back.select("machine_id", _ntz(), *[F.round(c, 9).alias(c) for c in (*config.FIXTURE_SENSORS, "scrap_probability")], "is_scrap_actual")


# --- P13 over that layout: only the days of each machine's window are read ------
@register("recent_window_pruned", fixture_sql(f"""
SELECT h.machine_id, h.timestamp, {", ".join(f"round(h.{s}, 9) AS {s}" for s in config.FIXTURE_SENSORS)}
FROM hist h JOIN (SELECT machine_id, max(timestamp) - INTERVAL 60 MINUTE AS hi FROM hist GROUP BY 1) m USING (machine_id)
WHERE h.timestamp BETWEEN m.hi - INTERVAL 4320 MINUTE AND m.hi""", history_cte()))
def q_recent_pruned(spark, sf):
    r = H.recent(spark, _kept_history(spark, sf), 4320)
    return r.select("machine_id", _ntz(), *[F.round(c, 9).alias(c) for c in config.FIXTURE_SENSORS])
