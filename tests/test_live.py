"""Live state (L1-L5): hand-traced sequence, stream = batch twin."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from moldwatch.streaming import live as L

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _readings(spark, seq):
    rows = [("M1", v, x, T0 + dt.timedelta(seconds=i), i) for i, (v, x) in enumerate(seq)]
    return spark.createDataFrame(rows, L.READING_SCHEMA)


SEQ = [("Cushion", 1.0),          # first reading: live
       ("Cycle_time", 30.0),      # new sensor while shared unchanged: offline, not recorded
       ("Cycle_time", 30.0),      # differs from the recorded snapshot on... nothing shared changed: offline
       ("Cushion", 2.0),          # change: live (recorded)
       ("Cushion", 2.0),          # repeat: frozen -> offline
       ("Cycle_time", 0.1),       # not cycling: offline
       ("Cushion", 3.0),          # Cycle_time still 0.1 in the buffer: offline
       ("Cycle_time", 25.0),      # cycling again, differs from snapshot: live
       ("__clear__", None),       # control message: buffer emptied, snapshot kept
       ("Cushion", 3.0)]          # equal to the recorded snapshot's Cushion: offline
EXPECTED = ["success", "offline", "offline", "success", "offline", "offline", "offline", "success",
            "cleared", "offline"]


def test_hand_traced_sequence(spark):
    out = L.live_status_twin(_readings(spark, SEQ)).orderBy("seq").collect()
    assert [r.status for r in out] == EXPECTED
    assert [r.sensors_buffered for r in out] == [1, 2, 2, 2, 2, 2, 2, 2, 0, 1]


def test_stream_equals_batch_twin(spark):
    r = _readings(spark, SEQ * 3).withColumn("machine_id", F.concat(F.lit("M"), (F.col("seq") % 2).cast("string")))
    a = sorted(map(tuple, L.live_status_replay(spark, r).select("machine_id", "seq", "status").collect()))
    b = sorted(map(tuple, L.live_status_twin(r).select("machine_id", "seq", "status").collect()))
    assert a == b and len(a) == 30


@pytest.mark.parametrize("batch", [1, 20, 10000])
def test_results_do_not_depend_on_the_arrow_batch(spark, batch):
    rng = random.Random(3)
    rows = [(f"M{rng.randint(0, 1)}", rng.choice(["Cushion", "Cycle_time", "Tmp"]), float(rng.randint(0, 3)),
             T0 + dt.timedelta(seconds=rng.randint(0, 200)), i) for i in range(300)]
    r = spark.createDataFrame(rows, L.READING_SCHEMA).repartition(7)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, batch)
    try:
        got = sorted(map(str, L.live_status_replay(spark, r).collect()))
        rolled = L.replay(spark, r, lambda s: L.live_rolling_stream(s, 60, cap=40), "roll")
        rolled = sorted(map(str, rolled.withColumns({c: F.round(c, 9) for c in ("mean", "std")}).collect()))
    finally:
        spark.conf.unset(key)
    assert got == sorted(map(str, L.live_status_twin(r).collect()))
    assert rolled == sorted(map(str, _plain_rolling(rows, 60, 40)))


@pytest.mark.parametrize("chunk", [50, 100000])
def test_buffered_frames_in_chunks_equal_one_reading_at_a_time(spark, chunk):
    from moldwatch.operators.rolling import rolling_buffered
    rng = random.Random(4)
    sensors = ["Cushion", "Cycle_time", "Tmp"]
    rows = [(f"M{rng.randint(0, 1)}", rng.choice(sensors), float(rng.randint(0, 3)),
             T0 + dt.timedelta(seconds=rng.randint(0, 200)), i) for i in range(400)]
    odd = [(None, "Tmp", 1.0, T0, 900), ("M0", "Tmp", 1.0, None, 901)]
    r = spark.createDataFrame(rows + odd, L.READING_SCHEMA).repartition(5)
    got = rolling_buffered(r, sensors, 60, cap=40, chunk_rows=chunk).withColumns({c: F.round(c, 9) for c in ("mean", "std")})
    expected = _plain_rolling(rows, 60, 40)
    assert sorted(map(str, got.select(*expected[0].__fields__).collect())) == sorted(map(str, expected))
    assert rolling_buffered(r.limit(0), sensors, 60, cap=40).count() == 0


def _plain_rolling(rows, window_s, cap, min_rows=3):
    """Buffered rolling features, one reading at a time."""
    out = []
    for m in sorted({r[0] for r in rows}):
        buf = []
        for _, var, val, ts, seq in sorted((r for r in rows if r[0] == m), key=lambda r: (r[3], r[4])):
            buf = [*buf, (ts, var, val)][-cap:]
            if len(buf) < min_rows:
                continue
            for s in sorted({b[1] for b in buf}):
                own = [b[2] for b in buf if b[1] == s]
                w = [b[2] for b in buf if b[1] == s and b[0] >= ts - dt.timedelta(seconds=window_s)]
                v = w or own[-1:]
                std = float(np.std(w, ddof=1)) if len(w) > 1 else 0.0
                out.append(Row(machine_id=m, seq=seq, timestamp=ts, sensor=s, mean=round(float(np.mean(v)), 9), std=round(std, 9),
                               min=min(v), max=max(v), last=v[-1]))
    return out


def test_ranges_are_replayed_in_time_order(spark, monkeypatch):
    monkeypatch.setattr(L, "DRAIN_ROWS", 8)
    r = _readings(spark, SEQ * 3)
    a = sorted(map(tuple, L.live_status_replay(spark, r).select("seq", "status", "sensors_buffered").collect()))
    b = sorted(map(tuple, L.live_status_twin(r).select("seq", "status", "sensors_buffered").collect()))
    assert a == b and len(a) == 30


def test_buffer_read_from_the_checkpointed_state(spark):
    """After each batch the state holds what the stream's own rows say, and a later batch goes on from it."""
    rows = [("M1", "a", 1.0, 1), ("M1", "b", 2.0, 2), ("M2", "a", 3.0, 3), ("M1", "a", 4.0, 4), ("M1", "c", 5.0, 5),
            ("M2", "__clear__", None, 6)]
    base = L.scratch_dir(spark, "state-test")
    for part, expected in ((rows[:3], {"M1": ["a", "b"], "M2": ["a"]}), (rows[3:5], {"M1": ["a", "b", "c"], "M2": ["a"]}),
                           (rows[5:], {"M1": ["a", "b", "c"], "M2": []})):
        df = spark.createDataFrame([(m, v, x, T0 + dt.timedelta(seconds=s), s) for m, v, x, s in part], L.READING_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(L.READING_SCHEMA).parquet(f"{base}/in")
        q = (L.live_status_stream(stream).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        state = {r["machine_id"]: (r["buffer_size"], r["sensors"]) for r in L.state_buffer(spark, f"{base}/ckpt").collect()}
        assert state == {m: (len(v), v) for m, v in expected.items()}
        own = {r["machine_id"]: r["buffer_size"] for r in L.buffer_status(spark.read.parquet(f"{base}/out")).collect()}
        assert own == {m: len(v) for m, v in expected.items()}


class _Held:
    """A group's state as the stream hands it to a fold."""
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def _group(n):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"machine_id": "M1", "variable_name": rng.choice(["Cushion", "Cycle_time", "Tmp"], n), "value": rng.integers(0, 4, n) * 1.0,
                        "timestamp": pd.Timestamp(T0) + pd.to_timedelta(rng.integers(0, n, n), unit="s"), "seq": np.arange(n)})
    return [pdf.iloc[n // 2:], pdf.iloc[:n // 2]]


def test_a_large_group_leaves_the_fold_in_slices(monkeypatch):
    """What a machine's readings become is given out in bounded frames, equal to one frame of all."""
    monkeypatch.setattr(L, "SLICE_ROWS", 500, raising=False)
    state = _Held()
    frames = list(L._stateful(("M1",), iter(_group(2300)), state))
    want, end = L._fold("M1", pd.concat(_group(2300)), dict(L._EMPTY))
    assert max(map(len, frames)) <= 500
    assert [tuple(r) for r in pd.concat(frames).itertuples(index=False)] == [tuple(r) for r in pd.DataFrame(want, columns=L._COLS).itertuples(index=False)]
    assert state.get == (end["keys"], end["vals"], end["prev_keys"], end["prev_vals"], end["has_prev"])


def test_a_large_group_leaves_the_rolling_fold_in_slices(monkeypatch):
    monkeypatch.setattr(L, "SLICE_ROWS", 500, raising=False)
    made = []

    class Grouped:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, fn, *_):
            made.append(fn)

    L.live_rolling_stream(Grouped(), 60, cap=40)
    state = _Held()
    frames = list(made[0](("M1",), iter(_group(2300)), state))
    want, end = L._roll_fold("M1", pd.concat(_group(2300)), {"ts": [], "var": [], "val": []}, 60_000_000, 40, 3)
    assert max(map(len, frames)) <= 500 * 3  # a row a sensor
    order = ["seq", "sensor"]
    got = pd.concat(frames).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[L._RCOLS].sort_values(order).reset_index(drop=True), rtol=1e-12)
    assert state.get == (end["ts"], end["var"], end["val"])
