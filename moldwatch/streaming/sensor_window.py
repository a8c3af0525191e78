"""Rolling features per (machine, sensor) with time-bounded state (L4).

Each reading gets the statistics of its sensor's readings in the closed frame
``[t - window, t]``, itself and those before it in (timestamp, seq) order.  The key is
(machine, sensor), so a machine's work spreads over its sensors; the state is a list of
the readings that a later frame may still need:

  * a reading may come as late as the watermark, so readings back to
    ``min(newest, watermark) - window`` are held, others are dropped;
  * an event-time timer at the oldest held reading plus the window evicts what the
    watermark has left behind, also for sensors that no longer report.

A late reading (behind newer ones, ahead of the watermark) gets its own frame; rows already
emitted are not revised.  Readings behind the watermark are dropped by the engine; readings
without machine, sensor, time or value are left out (NaN counts as no value).  Repeated
readings count as often as they come.  ``live.live_rolling_stream`` is the other published
form: the last N readings of the machine, whatever their age.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moldwatch.operators.frames import frame_stats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("machine_id", "variable_name")
HELD = "held"
HELD_SCHEMA = T.StructType([T.StructField("us", T.LongType()), T.StructField("seq", T.LongType()),
                            T.StructField("value", T.DoubleType())])
OUTPUT_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])


def frames_of_new(us, seq, value, new, window_us: int) -> tuple[np.ndarray, tuple]:
    """Orders the readings by (us, seq); returns that order and, for the ``new`` ones in it, their
    (n, mean, std, min, max) over ``[us - window_us, us]`` up to themselves."""
    order = np.lexsort((seq, us))
    t = us[order]
    at = np.flatnonzero(new[order])
    lo = np.searchsorted(t, t[at] - window_us, "left")
    n, mean, spread, least, most = frame_stats(value[order][:, None], lo, at + 1)
    std = np.sqrt(spread[:, 0] / np.maximum(n[:, 0] - 1, 1))
    return order, (n[:, 0].astype(np.int64), mean[:, 0], std, least[:, 0], most[:, 0])


class SensorWindow(StatefulProcessor):
    """List state of one sensor's readings, evicted by event time."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState(HELD, HELD_SCHEMA)

    def _read(self):
        rows = list(self.held.get()) if self.held.exists() else []
        us, seq, value = zip(*rows) if rows else ((), (), ())
        return np.array(us, np.int64), np.array(seq, np.int64), np.array(value, np.float64)

    def _write(self, us, seq, value, watermark_us: int) -> None:
        """Keeps what a later frame may need and sets the one timer of this key."""
        if len(us):
            keep = us >= min(us.max(), watermark_us) - self.window_us
            us, seq, value = us[keep], seq[keep], value[keep]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not len(us):
            self.held.clear()
            return
        self.held.put(list(zip(us.tolist(), seq.tolist(), value.tolist())))
        # A frame that begins at the watermark minus the window still holds a reading of just that time.
        due = (int(us.min()) + self.window_us) // 1000 + 1
        self.handle.registerTimer(max(due, watermark_us // 1000 + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        held = self._read()
        got = (pdf["timestamp"].to_numpy("datetime64[us]").astype(np.int64), pdf["seq"].to_numpy(np.int64),
               pdf["value"].to_numpy(np.float64))
        us, seq, value = (np.concatenate(pair) for pair in zip(held, got))
        new = np.arange(len(us)) >= len(held[0])
        order, (n, mean, std, least, most) = frames_of_new(us, seq, value, new, self.window_us)
        mine = order[new[order]] - len(held[0])
        self._write(us, seq, value, timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame({"machine_id": key[0], "sensor": key[1], "seq": got[1][mine],
                            "timestamp": pdf["timestamp"].to_numpy()[mine], "n": n, "mean": mean, "std": std,
                            "min": least, "max": most})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, seq, value = self._read()
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        late = us < watermark_us - self.window_us
        self._write(us[~late], seq[~late], value[~late], watermark_us)
        return iter([])

    def close(self) -> None:
        pass


def sensor_windows(readings: DataFrame, window_s: int, watermark: str = "1 hour") -> DataFrame:
    """Streaming: readings (``live.READING_SCHEMA``) -> one row of OUTPUT_SCHEMA per reading.  ``seq`` null
    counts as -1.  The stream must be started under ``rocksdb_state``."""
    x = readings.where(F.col("machine_id").isNotNull() & F.col("variable_name").isNotNull() & F.col("timestamp").isNotNull()
                       & F.col("value").isNotNull() & ~F.isnan("value"))
    x = x.select(*KEYS, F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), "timestamp", "value")
    return (x.withWatermark("timestamp", watermark).groupBy(*KEYS)
            .transformWithStateInPandas(SensorWindow(window_s * 1_000_000), OUTPUT_SCHEMA, "Append", "EventTime"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with timers needs; the
    session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def held_readings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The readings in the checkpointed state: machine_id, sensor, us, seq, value."""
    with rocksdb_state(spark):
        rows = spark.read.format("statestore").option("stateVarName", HELD).load(checkpoint)
    e = F.col("list_element")
    return rows.select(F.col("key.machine_id").alias("machine_id"), F.col("key.variable_name").alias("sensor"),
                       *[e[c].alias(c) for c in HELD_SCHEMA.fieldNames()])
