"""Time-bounded state per sensor (L4): brute force, restart from the checkpoint, eviction."""
import datetime as dt
import random
import statistics as st

from moldwatch.streaming import live as L
from moldwatch.streaming import sensor_window as W

T0 = dt.datetime(2024, 1, 1)


def _plain(rows, window_s):
    """One row per reading by the definition, over all pairs of a sensor."""
    rows = [r for r in rows if None not in r[:4] and r[2] == r[2]]
    out = {}
    for m, v, _, t, i in rows:
        x = [b[2] for b in rows if b[:2] == (m, v) and t - dt.timedelta(seconds=window_s) <= b[3] and (b[3], b[4]) <= (t, i)]
        out[(m, v, i)] = (len(x), round(sum(x) / len(x), 6), round(st.stdev(x) if len(x) > 1 else 0.0, 6), min(x), max(x))
    return out


def _result(df):
    return {(r.machine_id, r.sensor, r.seq): (r.n, round(r.mean, 6), round(r["std"], 6), r["min"], r["max"]) for r in df.collect()}


def _run(spark, base):
    stream = spark.readStream.schema(L.READING_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    with W.rocksdb_state(spark):
        q = (W.sensor_windows(stream, 60, "30 seconds").writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()


def test_equals_all_pairs_over_restarts_and_evicts(spark, tmp_path):
    rng = random.Random(5)
    base = str(tmp_path)
    rows = []
    for part in range(3):  # each part is a run of its own; the second one holds late but timely readings
        lo = part * 200 - (20 if part == 1 else 0)
        for _ in range(150):
            rows.append((rng.choice(["M1", "M1", "M2"]), rng.choice(["a", "b"]), float(rng.randint(0, 9)) + 1e9,
                         T0 + dt.timedelta(seconds=lo + rng.randint(0, 199)), len(rows)))
    parts = [rows[:150], rows[150:300], rows[300:]]
    odd = [(None, "a", 1.0, T0, 900), ("M1", None, 1.0, T0, 901), ("M1", "a", None, T0, 902), ("M1", "a", 1.0, None, 903),
           ("M1", "a", float("nan"), T0, 904)]
    seen = []
    expected = {}
    for i, p in enumerate(parts):
        spark.createDataFrame(p + (odd if i == 0 else []), L.READING_SCHEMA).repartition(3).write.parquet(f"{base}/in/{i}")
        _run(spark, base)
        seen += p
        whole = _plain(seen, 60)
        expected.update({(m, v, i): whole[(m, v, i)] for m, v, _, _, i in p})  # rows emitted are not revised
        held = W.held_readings(spark, f"{base}/ckpt").collect()
        newest = max(r[3] for r in seen)
        mark = int((newest - T0).total_seconds()) - 30 + int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
        assert held and all(r.us >= (mark - 60) * 1_000_000 for r in held)
        needed = {(r[0], r[1], r[4]) for r in seen if r[3] >= newest - dt.timedelta(seconds=60)}
        assert needed - {(r.machine_id, r.sensor, r.seq) for r in held} == set()
    assert _result(spark.read.parquet(f"{base}/out")) == expected


def test_a_quiet_sensor_leaves_no_state(spark, tmp_path):
    base = str(tmp_path)
    first = [("M1", "a", 1.0, T0, 0), ("M1", "b", 2.0, T0, 1)]
    later = [("M1", "b", 3.0, T0 + dt.timedelta(hours=1), 2)]
    for i, p in enumerate([first, later]):
        spark.createDataFrame(p, L.READING_SCHEMA).write.parquet(f"{base}/in/{i}")
        _run(spark, base)
    held = W.held_readings(spark, f"{base}/ckpt").select("sensor", "seq").collect()
    assert [tuple(r) for r in held] == [("b", 2)]


def test_ties_repeats_and_an_empty_stream(spark, tmp_path):
    base = str(tmp_path / "ties")
    rows = [("M1", "a", float(i), T0, i // 2) for i in range(6)]  # one time, each seq twice
    spark.createDataFrame(rows, L.READING_SCHEMA).write.parquet(f"{base}/in/0")
    _run(spark, base)
    assert sorted(r.n for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 3, 4, 5, 6]
    base = str(tmp_path / "empty")
    spark.createDataFrame([], L.READING_SCHEMA).write.parquet(f"{base}/in/0")
    _run(spark, base)
    assert spark.read.schema(W.OUTPUT_SCHEMA).parquet(f"{base}/out").count() == 0
