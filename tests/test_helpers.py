"""Schema helpers, cutoff split, window variants, JSON message stream."""
import datetime as dt
import json

from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions.schema import first_label, leakage_excluded, missing_columns, resolve_column
from moldwatch.operators.ingest import recent_window, split_by_cutoff
from moldwatch.sources import files as S
from moldwatch.streaming import live as L

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, "x", 1)],
                               "Cycle_time__last_5m double, Shot_counter__mean_5m double, "
                               "Shot_counterX int, name string, early_scrap_risk int")
    assert resolve_column(df, "Cycle_time") == "Cycle_time__last_5m"
    assert resolve_column(df, "Cushion") is None
    assert first_label(df) == "early_scrap_risk"
    # exact or block rule keeps 'Shot_counterX'; plain prefix rule drops it
    assert leakage_excluded(df, ["Shot_counter"]) == ["Cycle_time__last_5m", "Shot_counterX", "early_scrap_risk"]
    assert "Shot_counterX" not in leakage_excluded(df, ["Shot_counter"], mode="prefix")
    miss = missing_columns(spark, df, ["Cycle_time__last_5m", "Cushion__last_5m"]).collect()
    assert [r.column for r in miss] == ["Cushion__last_5m"]


def test_cutoff_split(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 11, 23, 59, 59),), (dt.datetime(2026, 1, 12),)],
                               "timestamp timestamp")
    got = [r.split for r in split_by_cutoff(df).orderBy("timestamp").collect()]
    assert got == ["TRAIN", "TEST"]


def test_recent_window_variants(spark):
    rows = [("M1", T0 + dt.timedelta(minutes=m)) for m in range(0, 301, 10)]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp")
    # status path: anchor = max - 1 h, 5 min back, both ends inclusive
    a = recent_window(df, 5).collect()
    assert [r.timestamp for r in a] == [T0 + dt.timedelta(minutes=240)]
    # tail extract (P14): last 4 h from the machine's own max
    b = recent_window(df, 240, anchor_offset_minutes=0).count()
    assert b == 25
    # trend variant (P15): last 60 min from the machine's own max
    assert recent_window(df, 60, anchor_offset_minutes=0).count() == 7


def test_json_message_stream(spark, tmp_path):
    src = tmp_path / "messages"
    src.mkdir()
    msgs = [{"machine_id": "m-231", "variable_name": "Cushion", "value": "4.5", "timestamp": "2024-01-01T12:00:00Z"},
            {"machine_id": "m-231", "variable_name": "Cycle_time", "value": "N/A", "timestamp": "2024-01-01T12:00:05Z"},
            {"machine_id": "M231", "variable_name": "Cycle_time", "value": "30", "timestamp": "2024-01-01T12:00:09Z"}]
    (src / "part-0.json").write_text("\n".join(json.dumps(m) for m in msgs))
    stream = S.read_live_messages(spark, str(src))
    q = (stream.writeStream.format("memory").queryName("live_msgs").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM live_msgs ORDER BY timestamp").collect()
    assert [(r.machine_id, r.variable_name, r.value) for r in rows] == [
        ("M231", "Cushion", 4.5), ("M231", "Cycle_time", None), ("M231", "Cycle_time", 30.0)]
    parsed = S.parse_live_messages(spark.createDataFrame([(json.dumps(msgs[0]),)], "value string")).collect()[0]
    assert parsed.value == 4.5 and parsed.timestamp == dt.datetime(2024, 1, 1, 12, 0, 0)


def test_watermark_dedup_and_windows(spark, tmp_path):
    rows = [("M1", "s", 1.0, T0, 0), ("M1", "s", 1.0, T0, 1), ("M1", "s", 3.0, T0 + dt.timedelta(hours=1), 2),
            ("M1", "s", 5.0, T0 + dt.timedelta(days=3), 3)]
    df = spark.createDataFrame(rows, L.READING_SCHEMA)
    out = L.replay(spark, df, lambda s: L.windowed_readings(L.dedup_readings(s, "1 day"), "6 hours", watermark=None),
                   "wm-test")
    got = [(r.n, r.mean_value) for r in out.orderBy("window_start").collect()]
    # the duplicate is dropped; the window of T0 closes once the watermark passes it
    assert got == [(2, 2.0)]


def test_config_limits_dimension(spark):
    lim = config.limits_df(spark)
    assert lim.count() == 15 and lim.where(F.col("sensor") == "Extruder_torque").first().min_limit == -1.0
