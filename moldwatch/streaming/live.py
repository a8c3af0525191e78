"""Live machine state (L1-L5) as a keyed stateful stream.

State per machine is tiny: the latest value of every sensor (L1) and the
last recorded snapshot for the frozen check (L2) -- at most two maps of
#sensors entries -- so it lives in the state store, checkpointed and
restored after executor loss.  Each micro-batch hands a machine only the
readings of that batch.

Rules (L2), in reading order (timestamp, then arrival ``seq``):
  * update the buffer with the reading (a ``__clear__`` control message
    empties the buffer, keeps the snapshot history and is answered with
    status "cleared" -- L5);
  * offline if Cycle_time <= 0.1 (snapshot not recorded);
  * else offline ("frozen") if a snapshot was recorded and every sensor in
    both the buffer and that snapshot has the same value (not recorded);
  * else live ("success"), and the buffer becomes the recorded snapshot.

``live_status_stream`` is the streaming operator; ``live_status_replay``
runs it over a batch DataFrame in time ranges of bounded size, each drained with an
availableNow trigger (never a whole machine history in one group).  ``live_status_twin`` is the
per-machine ``applyInPandas`` twin used by the tests on small fixtures.
"""
from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moldwatch.operators.frames import frame_stats


def _ship_by_value() -> None:
    """Serialize this module's Python functions by value, so executors need
    no installed copy of the package (same effect as ``--py-files``)."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


CLEAR = "__clear__"
HEARTBEAT = "__heartbeat__"
OFFLINE_CYCLE = 0.1

READING_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("vals", T.ArrayType(T.DoubleType())),
    T.StructField("prev_keys", T.ArrayType(T.StringType())),
    T.StructField("prev_vals", T.ArrayType(T.DoubleType())),
    T.StructField("has_prev", T.BooleanType()),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("sensors_buffered", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("sensor_keys", T.ArrayType(T.StringType())),
    T.StructField("sensor_vals", T.ArrayType(T.DoubleType())),
])


def _fold(machine_id: str, pdf: pd.DataFrame, state: dict) -> tuple[list, dict]:
    """Apply the rules to the readings of one machine; returns output rows
    and the new state.  Pure Python over one micro-batch of one machine."""
    buf = dict(zip(state["keys"], state["vals"]))
    prev = dict(zip(state["prev_keys"], state["prev_vals"])) if state["has_prev"] else None
    out = []
    pdf = pdf.sort_values(["timestamp", "seq"], kind="stable")
    for var, val, ts, seq in zip(pdf["variable_name"], pdf["value"], pdf["timestamp"], pdf["seq"].tolist()):
        if var == CLEAR:
            # control message: empty the buffer, keep the snapshot history,
            # no status evaluation
            buf = {}
            out.append((machine_id, seq, ts, var, 0, "cleared", [], []))
            continue
        if var is not None and val is not None and not pd.isna(val):
            buf[var] = float(val)
        ct = buf.get("Cycle_time")
        if ct is not None and ct <= OFFLINE_CYCLE:
            status = "offline"
        else:
            shared = set(buf) & set(prev) if prev is not None else set()
            if shared and all(buf[k] == prev[k] for k in shared):
                status = "offline"
            else:
                status = "success"
                prev = dict(buf)
        keys = sorted(buf)
        out.append((machine_id, seq, ts, var, len(buf), status, keys, [buf[k] for k in keys]))
    new_state = {"keys": list(buf), "vals": list(buf.values()),
                 "prev_keys": list(prev) if prev is not None else [],
                 "prev_vals": list(prev.values()) if prev is not None else [],
                 "has_prev": prev is not None}
    return out, new_state


_EMPTY = {"keys": [], "vals": [], "prev_keys": [], "prev_vals": [], "has_prev": False}
SLICE_ROWS = 20_000  # readings of a group that are folded, and given out, at a time
_COLS = [f.name for f in OUTPUT_SCHEMA.fields]


def _slices(pdf_iter):
    """The readings of a group in order, SLICE_ROWS at a time.  A group may come in several Arrow chunks, in
    any order: all of it is sorted first; the machine's name is not held."""
    pdf = pd.concat([p[["variable_name", "value", "timestamp", "seq"]] for p in pdf_iter])
    order = np.lexsort((pdf["seq"].to_numpy(), pdf["timestamp"].to_numpy()))
    for i in range(0, len(order), SLICE_ROWS):
        yield pdf.iloc[order[i:i + SLICE_ROWS]]


def _stateful(key, pdf_iter, state):
    from pyspark.sql.streaming.state import GroupState  # noqa: F401
    (machine_id,) = key
    st = dict(_EMPTY)
    if state.exists:
        k, v, pk, pv, hp = state.get
        st = {"keys": list(k or []), "vals": list(v or []), "prev_keys": list(pk or []),
              "prev_vals": list(pv or []), "has_prev": bool(hp)}
    for part in _slices(pdf_iter):
        rows, st = _fold(machine_id, part, st)
        yield pd.DataFrame(rows, columns=_COLS)
    state.update((st["keys"], st["vals"], st["prev_keys"], st["prev_vals"], st["has_prev"]))


def live_status_stream(readings: DataFrame) -> DataFrame:
    """Streaming: readings (READING_SCHEMA) -> one status row per reading."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    _ship_by_value()
    return readings.groupBy("machine_id").applyInPandasWithState(
        _stateful, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def live_status_twin(readings: DataFrame) -> DataFrame:
    """Batch twin for small fixtures (tests): one group per machine."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=_COLS)
        out, _ = _fold(pdf["machine_id"].iloc[0], pdf, dict(_EMPTY))
        return pd.DataFrame(out, columns=_COLS)
    _ship_by_value()
    return readings.groupBy("machine_id").applyInPandas(fn, OUTPUT_SCHEMA)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, deleted when the application ends."""
    from moldwatch.session import scratch_path
    return scratch_path(spark, name)


DRAIN_ROWS = 2_000_000


def replay(spark: SparkSession, readings: DataFrame, stream_fn, name: str, flush: str | None = None,
           base: str | None = None) -> DataFrame:
    """Replay a batch of readings through a streaming operator (file source, parquet sink,
    all in the shared checkpoint folder).

    The readings are written once, in time ranges of about DRAIN_ROWS rows; the ranges
    are handed to the stream one after the other, each drained with an availableNow
    trigger from the same checkpoint.  So they arrive in time order whatever the
    storage does with file times, and a micro-batch holds one range.  ``flush``: an
    interval; a last heartbeat reading that much later closes the event-time
    windows before it (it is not in the result itself).  ``base``: the folder, else a
    new one; the stream's checkpoint is its ``ckpt``."""
    base = base or scratch_dir(spark, name)
    columns = READING_SCHEMA.fieldNames()
    stats = readings.agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last")).first()
    ranges = max(1, -(-stats["n"] // DRAIN_ROWS))
    cuts = []
    if ranges > 1:  # ranges - 1 numbers
        us = readings.select(F.unix_micros("timestamp").cast("double").alias("t"))
        cuts = sorted(set(us.approxQuantile("t", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    part = sum((F.when(F.unix_micros("timestamp") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    readings.select(*columns).withColumn("_range", part).write.partitionBy("_range").parquet(f"{base}/ranges")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))
    steps = [f"{base}/ranges/_range={i}" for i in range(len(cuts) + 1)]
    if flush and stats["last"] is not None:
        beat = spark.range(1).select(F.lit(HEARTBEAT).alias("machine_id"), F.lit(HEARTBEAT).alias("variable_name"),
                                     F.lit(0.0).alias("value"), (F.lit(stats["last"]) + F.expr(f"INTERVAL {flush}")).alias("timestamp"),
                                     F.lit(-1).cast("long").alias("seq"))
        beat.write.parquet(f"{base}/beat")
        steps.append(f"{base}/beat")
    for i, step in enumerate(steps):
        if fs.exists(path(step)):
            fs.rename(path(step), path(f"{base}/in/{i}"))
        stream = spark.readStream.schema(READING_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        q = (stream_fn(stream).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out").where(F.col("machine_id") != HEARTBEAT)


def live_status_replay(spark: SparkSession, readings: DataFrame) -> DataFrame:
    """Replay a batch of readings through the live-state operator."""
    return replay(spark, readings, live_status_stream, "live-replay")


def state_buffer(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Buffer per machine read from the checkpointed state of the live-state stream (L5): machine_id,
    buffer_size, sensors (sorted), has_previous.  It is what the next batch will start from; the
    stream may run or be at rest, and none of its output is read."""
    state = spark.read.format("statestore").load(checkpoint)
    s = F.col("value.groupState")
    return state.select(F.col("key.machine_id").alias("machine_id"), F.size(s["keys"]).alias("buffer_size"),
                        F.sort_array(s["keys"]).alias("sensors"), s["has_prev"].alias("has_previous")) \
        .where(F.col("machine_id") != HEARTBEAT)


def buffer_status(status_rows: DataFrame) -> DataFrame:
    """Buffer size per machine after its last reading."""
    return status_rows.groupBy("machine_id").agg(
        F.max_by("sensors_buffered", F.struct("timestamp", "seq")).alias("buffer_size"))


def live_features(status_rows: DataFrame, features) -> DataFrame:
    """Wide model row from the buffered map; missing sensors 0 (L3, P20)."""
    m = F.map_from_arrays("sensor_keys", "sensor_vals")
    return status_rows.select("*", *[F.coalesce(m[f], F.lit(0.0)).alias(f) for f in features])


def live_scores(status_rows: DataFrame, model, features) -> DataFrame:
    """Live risk: model probability (4 dp) when live, 0 when offline (L3)."""
    from pyspark.ml.functions import vector_to_array
    x = model.transform(live_features(status_rows, features))
    p = vector_to_array(F.col("probability"))[1]
    risk = F.when(F.col("status") == "offline", F.lit(0.0)).otherwise(F.round(p, 4))
    return x.select("machine_id", "seq", "timestamp", "sensors_buffered", "status",
                    risk.alias("risk_score"))


def windowed_readings(stream: DataFrame, window: str = "6 hours", slide: str | None = None,
                      watermark: str | None = "1 day") -> DataFrame:
    """Event-time windows with a watermark (L7): count / mean / max per
    machine and sensor; late rows beyond the watermark are dropped.
    ``watermark=None`` keeps a watermark defined upstream (e.g. by
    ``dedup_readings``)."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    src = stream.withWatermark("timestamp", watermark) if watermark else stream
    return (src
            .groupBy("machine_id", "variable_name", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
                 F.max("value").alias("max_value"))
            .select("machine_id", "variable_name", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n", "mean_value", "max_value"))


def dedup_readings(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Drop duplicate readings within the watermark."""
    return stream.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(
        ["machine_id", "variable_name", "timestamp"])



# --- L4: buffered rolling features over the last readings -------------------
ROLL_STATE_SCHEMA = T.StructType([
    T.StructField("ts", T.ArrayType(T.LongType())),
    T.StructField("var", T.ArrayType(T.StringType())),
    T.StructField("val", T.ArrayType(T.DoubleType())),
])

ROLL_OUTPUT_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("last", T.DoubleType()),
])
_RCOLS = [f.name for f in ROLL_OUTPUT_SCHEMA.fields]


def _roll_fold(machine_id, pdf, st, window_us: int, cap: int, min_rows: int):
    """Buffer of the last ``cap`` readings; at each reading, per sensor in
    the buffer: stats over its values with ts >= now - window (closed); an
    empty window falls back to the sensor's last buffered value with std 0;
    fewer than ``min_rows`` buffered readings -> no features.  All readings of
    a slice at once (see ``operators.frames``)."""
    pdf = pdf.sort_values(["timestamp", "seq"], kind="stable")
    old = len(st["ts"])
    ts = np.concatenate([np.array(st["ts"], np.int64), pdf["timestamp"].to_numpy("datetime64[us]").astype(np.int64)])
    var = np.concatenate([np.array(st["var"], object), pdf["variable_name"].to_numpy(object)])
    val = np.concatenate([np.array(st["val"], np.float64), pdf["value"].to_numpy(np.float64)])
    names = sorted(set(var))
    at = np.arange(len(ts))
    x = np.where(var[:, None] == np.array(names, object), val[:, None], np.nan)
    newest = np.maximum.accumulate(np.where(np.isnan(x), -1, at[:, None]), axis=0)
    now = np.arange(old, len(ts))
    buffer = np.maximum(now - cap + 1, 0)
    lo = np.minimum(np.maximum(buffer, np.searchsorted(ts, ts[now] - window_us, "left")), now + 1)
    n, mean, spread, least, most = frame_stats(x, lo, now + 1)
    parts = []
    for c, name in enumerate(names):
        last = newest[now, c]
        shown = (last >= buffer) & (now + 1 - buffer >= min_rows)
        v, some = val[np.maximum(last, 0)], n[:, c] > 0
        std = np.sqrt(spread[:, c] / np.maximum(n[:, c] - 1, 1))
        parts.append(pd.DataFrame({
            "machine_id": machine_id, "seq": pdf["seq"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy(), "sensor": name,
            "mean": np.where(some, mean[:, c], v), "std": np.where(n[:, c] > 1, std, 0.0), "min": np.where(some, least[:, c], v),
            "max": np.where(some, most[:, c], v), "last": v})[shown])
    return pd.concat(parts), {"ts": ts[-cap:].tolist(), "var": var[-cap:].tolist(), "val": val[-cap:].tolist()}


def live_rolling_stream(readings: DataFrame, window_s: int, cap: int, min_rows: int = 3) -> DataFrame:
    """Streaming buffered rolling features per machine (L4); the state is the
    last ``cap`` readings (the buffer length, bounded)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    window_us = window_s * 1_000_000

    def fn(key, pdf_iter, state):
        (machine_id,) = key
        st = {"ts": [], "var": [], "val": []}
        if state.exists:
            a, b, c = state.get
            st = {"ts": list(a or []), "var": list(b or []), "val": list(c or [])}
        for part in _slices(pdf_iter):
            rows, st = _roll_fold(machine_id, part, st, window_us, cap, min_rows)
            if len(rows):
                yield rows[_RCOLS]
        state.update((st["ts"], st["var"], st["val"]))

    _ship_by_value()
    return readings.groupBy("machine_id").applyInPandasWithState(
        fn, ROLL_OUTPUT_SCHEMA, ROLL_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def live_append_timeline(history: DataFrame, status_rows: DataFrame, sensors) -> DataFrame:
    """Timeline rows + each machine's latest live reading as the newest point
    (L6): a static history unioned with the live state's last row."""
    last = status_rows.groupBy("machine_id").agg(
        F.max_by(F.struct("timestamp", "sensor_keys", "sensor_vals", "status"), F.struct("timestamp", "seq")).alias("_l"))
    m = F.map_from_arrays("_l.sensor_keys", "_l.sensor_vals")
    live = last.select("machine_id", F.col("_l.timestamp").alias("timestamp"),
                       *[m[s].alias(s) for s in sensors], F.lit(True).alias("is_live"))
    return history.select("machine_id", "timestamp", *sensors, F.lit(False).alias("is_live")) \
        .unionByName(live)
