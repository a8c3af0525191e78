"""History by machine and day: idempotent appends and windows that read only their own days."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from moldwatch.operators.ingest import recent_window
from moldwatch.session import scratch_path
from moldwatch.sources import history as H

T0 = dt.datetime(2024, 1, 1)


def rows_of(spark, days, machines=2):
    rows = [(f"M{m}", T0 + dt.timedelta(hours=6 * k + m), float(k)) for m in range(machines) for k in range(4 * days)]
    return spark.createDataFrame(rows, "machine_id string, timestamp timestamp, value double")


def test_a_repeated_run_changes_nothing(spark):
    path, df = scratch_path(spark, "kept"), rows_of(spark, 6)
    H.append(df, path)
    once = sorted(H.read(spark, path).select("machine_id", "timestamp", "value").collect())
    day3 = df.where(F.dayofmonth("timestamp") == 3)
    H.append(day3, path)
    H.append(day3, path)
    assert sorted(H.read(spark, path).select("machine_id", "timestamp", "value").collect()) == once == sorted(df.collect())
    H.append(day3.withColumn("value", F.lit(-1.0)), path)  # a corrected day replaces that day
    got = H.read(spark, path)
    assert got.where("value = -1").count() == day3.count() and got.count() == df.count()


def test_the_window_is_read_by_its_days_alone(spark):
    path, df = scratch_path(spark, "kept"), rows_of(spark, 40)
    H.append(df, path)
    want = sorted(recent_window(df, 2 * 1440).select("machine_id", "timestamp", "value").collect())
    assert want
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in ("2024-01-15", "2024-01-30", "2024-02-05"):  # unreadable, if anything reads them
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/machine_id=M1/day={day}/part-99999-x.snappy.parquet"))
        out.write(bytearray(b"PAR1 no parquet PAR1"))
        out.close()
    got = H.recent(spark, path, 2 * 1440)
    assert sorted(got.select("machine_id", "timestamp", "value").collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    with pytest.raises(Exception):
        H.read(spark, path).agg(F.sum("value")).collect()


def test_rows_without_a_key_are_refused(spark):
    for row in ((None, T0, 1.0), ("M1", None, 1.0)):
        with pytest.raises(Exception, match="machine and a time"):
            H.append(spark.createDataFrame([row], "machine_id string, timestamp timestamp, value double"), scratch_path(spark, "kept"))
