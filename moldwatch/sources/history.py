"""Scored history kept by machine and day.

``append`` replaces whole (machine, day) partitions and nothing else, so a run that is repeated
over a day leaves the same rows.  Beside the rows lies a small table of every machine's
newest timestamp; ``recent`` turns it into the (machine, day) pairs that a window touches and joins
the rows to these, which Spark turns into dynamic partition pruning: what is read depends on the window and the number of
machines, not on the length of the history.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moldwatch.sources.files import ROWS_PER_FILE, _spread

DAY = "day"


def _paths(path: str) -> tuple[str, str]:
    base = path.rstrip("/")
    return f"{base}/rows", f"{base}/newest"


def append(df: DataFrame, path: str, key: str = "machine_id", ts: str = "timestamp") -> None:
    """Write ``df``, which holds all rows of every (machine, UTC day) it touches; rows without
    machine or time raise, since no partition could hold them."""
    rows, newest = _paths(path)
    x = df.withColumn(DAY, F.to_date(F.col(ts).cast("timestamp"))).withColumn(
        key, F.when(F.col(key).isNotNull() & F.col(ts).isNotNull(), F.col(key)).otherwise(
            F.raise_error(F.lit("history rows need a machine and a time")).cast("string")))
    (_spread(x, [key, DAY]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(key, DAY).parquet(rows))
    days = x.groupBy(key, DAY).agg(F.max(ts).alias("max_ts"))  # a row per written partition
    (days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, DAY).parquet(newest))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, without the day column."""
    return spark.read.parquet(_paths(path)[0]).drop(DAY)


def recent(spark: SparkSession, path: str, minutes: float, anchor_offset_minutes: float = 60.0, key: str = "machine_id",
           ts: str = "timestamp") -> DataFrame:
    """Per machine the rows of [anchor - minutes, anchor], anchor being its newest timestamp less
    the offset (P13); both ends belong to the window."""
    rows, newest = _paths(path)
    back = lambda m: F.expr(f"make_dt_interval(0, 0, 0, {m * 60.0})")
    anchors = spark.read.parquet(newest).groupBy(key).agg((F.max("max_ts") - back(anchor_offset_minutes)).alias("_hi"))
    anchors = anchors.withColumn("_lo", F.col("_hi") - back(minutes))
    days = anchors.select(key, "_lo", "_hi", F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"))).alias(DAY))
    days = days.where(F.col("_lo") <= F.col("_hi"))  # a condition is what lets Spark prune by this side
    x = spark.read.parquet(rows).join(days, [key, DAY])
    return x.where((F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi"))).drop(DAY, "_lo", "_hi")
