"""Registered queries: ids and tools in all published forms, window and split variants, schema
helpers, live messages with a quarantine, versioned metrics (P5, P7, P8, P14, P15, P21, P23,
P25, U5, S9, ML7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import display_machine_id, normalize_machine_id, schema
from moldwatch.functions.columns import tool_from_definition
from moldwatch.operators.evaluate import confusion
from moldwatch.operators.ingest import recent_window, split_by_cutoff
from moldwatch.plans import fixtures as fx
from moldwatch.plans import oracle as O
from moldwatch.plans.catalog import register
from moldwatch.plans.oracle import fixture_sql
from moldwatch.plans.queries_eval import _conf_sql, _scored_xy
from moldwatch.sources import files as S
from moldwatch.sources.tables import telemetry_raw
from moldwatch.streaming.live import scratch_dir


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


# --- P5 + P7 + P8: display ids, tool ids of the second and third form ------------
# Definitions of many shapes: as they are, without the last part, with letters and digits mixed, empty.
SHAPES = ("d", "split_part(d, '-', 1)", "d || 'A7x09'", "d || '-'", "''", "d || ' z'")


@register("id_variants", fixture_sql(f"""
SELECT event_id, regexp_replace(m, '^M([0-9]+)$', 'M-\\1') AS display_id, definition,
  CASE WHEN regexp_matches(definition, '-([A-Za-z0-9]+)$') THEN regexp_extract(definition, '-([A-Za-z0-9]+)$', 1) ELSE 'UNKNOWN' END AS tool_b,
  coalesce(list_last(regexp_extract_all(list_last(string_split(definition, '-')), '[0-9]+')), 'UNKNOWN') AS tool_c
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'M10X' ELSE 'M' || substr(machine_id, 3) END AS m,
      CASE event_id % {len(SHAPES)} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SHAPES))} END AS definition
      FROM (SELECT *, machine_definition AS d FROM telemetry) t) x"""))
def q_id_variants(spark, sf):
    d, k = F.col("machine_definition"), F.col("event_id") % len(SHAPES)
    shape = (F.when(k == 0, d).when(k == 1, F.substring_index(d, "-", 1)).when(k == 2, F.concat(d, F.lit("A7x09")))
             .when(k == 3, F.concat(d, F.lit("-"))).when(k == 4, F.lit("")).otherwise(F.concat(d, F.lit(" z"))))
    m = F.when(F.col("event_id") % 3 == 0, F.lit("M10X")).otherwise(normalize_machine_id("machine_id"))
    x = telemetry_raw(spark, sf).select("event_id", m.alias("m"), shape.alias("definition"))
    return x.select("event_id", display_machine_id("m").alias("display_id"), "definition",
                    tool_from_definition("definition", "B").alias("tool_b"), tool_from_definition("definition", "C").alias("tool_c"))


# --- P14 + P15 + P25: the other windows and the split by a fixed time ---------------
TAIL_MIN, TREND_MIN = 240, 60


@register("window_variants", fixture_sql(f"""
SELECT event_id, timestamp >= last - INTERVAL {TAIL_MIN} MINUTE AS in_tail, timestamp >= last - INTERVAL {TREND_MIN} MINUTE AS in_trend,
  CASE WHEN timestamp <= TIMESTAMP '{config.TRAIN_CUTOFF}' THEN 'TRAIN' ELSE 'TEST' END AS split,
  CASE WHEN timestamp <= TIMESTAMP '2024-01-15 12:00:00' THEN 'TRAIN' ELSE 'TEST' END AS split_mid
FROM (SELECT *, max(timestamp) OVER (PARTITION BY machine_id) AS last FROM clean) t"""))
def q_window_variants(spark, sf):
    c = fx.clean(spark, sf)
    marks = [recent_window(c, m, 0).select("event_id", F.lit(True).alias(name)) for m, name in ((TAIL_MIN, "in_tail"), (TREND_MIN, "in_trend"))]
    x = split_by_cutoff(c).withColumnRenamed("split", "split_fixed")
    x = split_by_cutoff(x, "2024-01-15 12:00:00").withColumnRenamed("split", "split_mid")
    for m in marks:
        x = x.join(m, "event_id", "left")
    return x.select("event_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("in_tail", "in_trend")],
                    F.col("split_fixed").alias("split"), "split_mid")


# --- P21 + P23 + U5: columns found by name, first label, missing columns -------------
@register("schema_helpers", fixture_sql("""
SELECT machine_id, timestamp, round(Cushion, 9) AS found, CAST(is_scrap_actual AS INT) AS label,
  'early_scrap_risk,Shot_size' AS missing FROM hist""", O.history_cte()))
def q_schema_helpers(spark, sf):
    h = fx.history(spark, sf).withColumnRenamed("Cushion", "Cushion__last_5m")
    found, label = schema.resolve_column(h, "Cushion"), schema.first_label(h)
    lacking = schema.missing_columns(spark, h, ["machine_id", "Shot_size", "early_scrap_risk", "timestamp"])
    names = lacking.agg(F.array_join(F.array_sort(F.collect_list("column"), lambda a, b: F.when(a > b, -1).otherwise(1)), ",").alias("n"))
    return h.select("machine_id", _ntz(), F.round(found, 9).alias("found"), F.col(label).cast("int").alias("label"), names.scalar().alias("missing"))


# --- S9: live messages as text, the unreadable and incomplete ones set aside ----------
@register("live_messages", fixture_sql("""
SELECT 'M' || substr(machine_id, 3) AS machine_id, variable_name, timestamp, round(TRY_CAST(value AS DOUBLE), 9) AS value,
  CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS n
FROM telemetry WHERE event_id % 53 <> 0 AND event_id % 59 <> 0 AND event_id % 61 <> 0 AND value <> 'N/A'
UNION ALL
SELECT NULL, NULL, NULL, NULL, reason, count(*) FROM (
  SELECT CASE WHEN event_id % 53 = 0 THEN 'unreadable' WHEN event_id % 59 = 0 THEN 'no sensor' WHEN event_id % 61 = 0 THEN 'no time'
         WHEN value = 'N/A' THEN 'no value' END AS reason FROM telemetry) t WHERE reason IS NOT NULL GROUP BY reason"""))
def q_live_messages(spark, sf):
    path = scratch_dir(spark, "live-messages")
    k = F.col("event_id")
    fields = F.struct("machine_id", F.when(k % 59 != 0, F.col("variable_name")).alias("variable_name"), "value",
                      F.when(k % 61 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("soon").alias("timestamp"))
    text = F.to_json(fields)
    raw = telemetry_raw(spark, sf).select(F.when(k % 53 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value"))
    raw.write.text(f"{path}/in")
    S.ingest_messages(spark.readStream.text(f"{path}/in"), path)
    good = spark.read.parquet(f"{path}/readings").select("machine_id", "variable_name", _ntz(), F.round("value", 9).alias("value"),
                                                         F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    bad = spark.read.parquet(f"{path}/quarantine").groupBy("reason").agg(F.count("message").alias("n"))
    return good.unionByName(bad, allowMissingColumns=True)


# --- ML7: versioned metrics, the newest of each model read back -----------------------
@register("metrics_versions", fixture_sql(f"""
SELECT 'rule-a' AS model, 'v2' AS version, threshold, tp, fp, tn, fn FROM ({_conf_sql(0.5, ">=")}) a
UNION ALL SELECT 'rule-b', 'v1', threshold, tp, fp, tn, fn FROM ({_conf_sql(0.7, ">=")}) b"""))
def q_metrics_versions(spark, sf):
    path = scratch_dir(spark, "metrics")
    xy = _scored_xy(spark, sf)
    for model, version, cut in (("rule-a", "v1", 0.3), ("rule-b", "v1", 0.7), ("rule-a", "v2", 0.5)):
        record = confusion(xy, threshold=cut).select("threshold", "tp", "fp", "tn", "fn")
        S.append_metrics(record, path, model, version)
    return S.latest_metrics(spark, path, record.schema).drop("created_at")
