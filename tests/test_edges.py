"""Hand-written edge frames (FIXTURES.md part 3) and invariants."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import (display_machine_id, normalize_machine_id, compact_machine_id, to_number,
                                 tool_from_definition, is_idle)
from moldwatch.operators import asof, latest, limits, alerts, rolling, pattern, evaluate, sampling, stats
from moldwatch.operators.encode import apply_encoding, fit_label_encoding

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
US = dt.timedelta(microseconds=1)
MIN = dt.timedelta(minutes=1)


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- P1, P3-P8
def test_numeric_coercion(spark):
    vals = ["text", "", "NaN", "inf", "1d", " 3.5 ", "-2e3", None, ".5"]
    df = _df(spark, [(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(to_number("v")).collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == math.inf
    assert got[4] is None            # Spark would accept '1d'; the parser rule rejects it
    assert got[5:] == [3.5, -2000.0, None, 0.5]


def test_machine_ids(spark):
    df = _df(spark, [("m-231",), ("231",), (None,), ("M 612",)], "m string")
    got = [tuple(r) for r in df.select(normalize_machine_id("m"), compact_machine_id("m")).collect()]
    assert got == [("M231", "M231"), ("M231", "231"), ("M", None), ("M612", "M 612")]
    d = _df(spark, [("M231",), ("MX1",)], "m string").select(display_machine_id("m")).collect()
    assert [r[0] for r in d] == ["M-231", "MX1"]


def test_tool_variants(spark):
    df = _df(spark, [("LINE-1-57",), ("LINE57",), (None,), ("",), ("A-tool12x34",)], "d string")
    a = [r[0] for r in df.select(tool_from_definition("d", "A")).collect()]
    b = [r[0] for r in df.select(tool_from_definition("d", "B")).collect()]
    c = [r[0] for r in df.select(tool_from_definition("d", "C")).collect()]
    assert a == ["57", "LINE57", "UNKNOWN", "UNKNOWN", "tool12x34"]
    assert b == ["57", "UNKNOWN", "UNKNOWN", "UNKNOWN", "tool12x34"]
    assert c == ["57", "57", "UNKNOWN", "UNKNOWN", "34"]  # no "-": the whole string is the last segment


def test_unseen_category_encodes_to_zero(spark):
    train = _df(spark, [("23",), ("11",)], "tool_id string")
    enc = fit_label_encoding(train, "tool_id")
    assert sorted(map(tuple, enc.select("value", "code").collect())) == [("11", 0), ("23", 1)]
    x = apply_encoding(_df(spark, [("23",), ("99",), (None,)], "tool_id string"), enc, "tool_id")
    assert [r[0] for r in x.select("tool_id_encoded").collect()] == [1, 0, 0]


# ---------------------------------------------------------------- J1, J2, J4
def _readings(spark, ts_list):
    return _df(spark, [(i, "M1", t) for i, t in enumerate(ts_list)], "rid long, machine_id string, timestamp timestamp")


def _events(spark, ts_list):
    return _df(spark, [(100 + i, "M1", t) for i, t in enumerate(ts_list)],
               "eid long, machine_id string, event_ts timestamp")


def test_asof_tolerance_is_inclusive(spark):
    r = _readings(spark, [T0, T0 + dt.timedelta(hours=1)])
    e = _events(spark, [T0 + 5 * MIN, T0 + dt.timedelta(hours=1) + 5 * MIN + US])
    lab = asof.asof_label(r, e, direction="nearest", label="y").orderBy("rid").collect()
    assert [x.y for x in lab] == [1, 0]


def test_asof_nearest_tie_prefers_earlier(spark):
    r = _readings(spark, [T0])
    e = _events(spark, [T0 - 2 * MIN, T0 + 2 * MIN])
    m = asof.asof_nearest(r, e, payload=["eid"]).collect()[0]
    assert m.eid == 100 and m.match_gap_us == -120_000_000


def test_forward_interval_is_open_closed(spark):
    r = _readings(spark, [T0, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=4)])
    e = _events(spark, [T0, T0 + dt.timedelta(hours=2, minutes=30),
                        T0 + dt.timedelta(hours=4, minutes=30) + US])
    lab = asof.asof_label(r, e, direction="forward", tolerance_us=30 * 60_000_000, label="y")
    assert [x.y for x in lab.orderBy("rid").collect()] == [0, 1, 0]


def test_asof_across_chunk_border(spark):
    """A reading just after midnight sees an event just before it."""
    mid = dt.datetime(2024, 1, 2)
    r = _readings(spark, [mid + MIN])
    e = _events(spark, [mid - 3 * MIN])
    assert asof.asof_label(r, e, label="y").collect()[0].y == 1


@pytest.mark.parametrize("tol", [0, 1, 7, 300])
def test_asof_label_against_all_pairs(spark, tol):
    """Readings and events on and beside bucket borders, before 1970 too, with null keys and times and repeated rows."""
    rng = np.random.default_rng(tol)
    keys, epoch = ["M1", "M2", None], dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda: None if rng.random() < 0.05 else int(rng.integers(-40, 40)) * max(tol, 1) // 2 + int(rng.integers(-1, 2))
    left = [(i, keys[rng.integers(3)], at()) for i in range(150)]
    right = [(keys[rng.integers(3)], at()) for _ in range(25)] * 2
    time = F.timestamp_micros("t")
    l = spark.createDataFrame(left, "rid int, machine_id string, t long").withColumn("timestamp", time).drop("t")
    r = spark.createDataFrame(right, "machine_id string, t long").withColumn("event_ts", time).drop("t")
    for direction, lo, hi in (("nearest", -tol, tol), ("forward", 1, tol), ("backward", -tol, 0)):
        got = asof.asof_label(l, r, tolerance_us=tol, direction=direction, label="y")
        assert got.columns == [*l.columns, "y"]
        want = {i: int(any(k == m and None not in (t, e) and lo <= e - t <= hi for m, e in right)) for i, k, t in left}
        assert sorted((x.rid, x.y) for x in got.collect()) == sorted(want.items()), direction


def test_asof_label_neither_sorts_nor_windows_readings(spark):
    l, r = _readings(spark, [T0 + i * MIN for i in range(50)]), _events(spark, [T0])
    for df in (asof.asof_label(l, r, label="y"), asof.context_rows(l.withColumn("flag", F.lit(1)), "flag", by=["machine_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan and "ShuffledHashJoin" in plan


def test_temporal_split_keeps_rows_without_time(spark):
    from moldwatch.operators.sampling import temporal_split
    at = [dt.datetime(2024, 1, 1, h // 3, h) for h in range(12)]
    for nulls, train in ((3, 12), (20, 25)):  # the cut among the times' last rows, and inside the rows without one
        rows = [(i, t) for i, t in enumerate(at)] + [(100 + i, None) for i in range(nulls)]
        got = temporal_split(spark.createDataFrame(rows, "id int, t timestamp"), ["t", "id"], 0.8).collect()
        assert sorted(r["id"] for r in got) == [i for i, _ in rows]
        assert sorted(r["id"] for r in got if r["split"] == "TRAIN") == [i for i, _ in rows][:train]


def test_null_safe_join_keys(spark):
    a = _df(spark, [(1, None), (2, 1.0)], "k int, v double")
    b = _df(spark, [(None, "x"), (1.0, "y")], "v double, tag string")
    j = a.join(b, a["v"].eqNullSafe(b["v"]), "left").orderBy("k").collect()
    assert [x.tag for x in j] == ["x", "y"]


# ---------------------------------------------------------------- windows
def test_time_frame_edges_open_vs_closed(spark):
    w = 60
    long = _df(spark, [("M1", "s", T0, 1.0), ("M1", "s", T0 + dt.timedelta(seconds=w), 3.0),
                       ("M1", "s", T0 + dt.timedelta(seconds=2 * w) - US, 5.0)],
               "machine_id string, variable_name string, timestamp timestamp, value double")
    r = rolling.rolling_time_long(long, [("1m", w)], min_periods=1).orderBy("timestamp").collect()
    # (t - w, t]: the row exactly w earlier is outside
    assert [x["mean"] for x in r] == [1.0, 3.0, 4.0]
    wide = long.groupBy("machine_id", "timestamp").pivot("variable_name", ["s"]).avg("value")
    live = rolling.rolling_live(wide, ["s"], w, min_rows=1, name="1m").orderBy("timestamp").collect()
    # [t - w, t]: the row exactly w earlier is inside
    assert [x["s__mean_1m"] for x in live] == [1.0, 2.0, 4.0]


def test_row_frame_nulls_and_min_periods(spark):
    rows = [("M1", T0 + i * MIN, v) for i, v in enumerate([1.0, None, 3.0, None, 5.0])]
    wide = _df(spark, rows, "machine_id string, timestamp timestamp, s double")
    r = rolling.rolling_rows_wide(wide, ["s"], [("w", 30)]).orderBy("timestamp").collect()
    # min_periods = max(3, 30 // 10) = 3 non-null values
    assert [x["s__mean_w"] for x in r] == [None, None, None, None, 3.0]
    assert [x["s__last_w"] for x in r] == [None, None, None, None, 5.0]


def test_chunked_equals_plain_rolling(spark, ):
    rng = np.random.default_rng(7)
    n = 400
    ts = [T0 + dt.timedelta(minutes=int(m)) for m in np.sort(rng.choice(20000, n, replace=False))]
    long = _df(spark, [("M1", "s", t, float(v)) for t, v in zip(ts, rng.normal(size=n))],
               "machine_id string, variable_name string, timestamp timestamp, value double")
    wins = [("a", 3600), ("b", 6 * 3600)]
    small = rolling.rolling_time_long(long, wins, min_periods=2, chunk_us=86_400_000_000)
    big = rolling.rolling_time_long(long, wins, min_periods=2, chunk_us=10 ** 15)
    key = ["window", "timestamp"]
    a = small.orderBy(key).collect()
    b = big.orderBy(key).collect()
    assert len(a) == len(b) == 2 * n
    for x, y in zip(a, b):
        for c in ("mean", "std", "min", "max", "last"):
            assert (x[c] is None and y[c] is None) or abs(x[c] - y[c]) < 1e-12


def test_row_chunked_equals_unchunked(spark):
    rng = np.random.default_rng(3)
    rows = [("M1", T0 + dt.timedelta(minutes=i), float(v) if i % 7 else None)
            for i, v in enumerate(rng.normal(size=300))]
    wide = _df(spark, rows, "machine_id string, timestamp timestamp, s double")
    a = rolling.rolling_rows_wide(wide, ["s"], [("w", 30)], chunk_rows=37).orderBy("timestamp").collect()
    b = rolling.rolling_rows_wide(wide, ["s"], [("w", 30)], chunk_rows=10_000).orderBy("timestamp").collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
    lag_a = rolling.lag_features(wide.fillna(0.0), ["s"], 3, chunk_rows=41).orderBy("timestamp").collect()
    lag_b = rolling.lag_features(wide.fillna(0.0), ["s"], 3, chunk_rows=10_000).orderBy("timestamp").collect()
    assert [tuple(x) for x in lag_a] == [tuple(x) for x in lag_b]


def test_pandas_parity_time_rolling(spark):
    rng = np.random.default_rng(11)
    n = 500
    ts = pd.to_datetime(np.sort(rng.choice(10 ** 6, n, replace=False)), unit="s")
    vals = rng.normal(size=n)
    long = _df(spark, [("M1", "s", t.to_pydatetime(), float(v)) for t, v in zip(ts, vals)],
               "machine_id string, variable_name string, timestamp timestamp, value double")
    got = rolling.rolling_time_long(long, [("x", 7200)], min_periods=3).orderBy("timestamp").toPandas()
    s = pd.Series(vals, index=ts)
    exp = s.rolling("7200s", min_periods=3)
    np.testing.assert_allclose(got["mean"].astype(float), exp.mean().values, rtol=1e-10, equal_nan=True)
    np.testing.assert_allclose(got["std"].astype(float), exp.std().values, rtol=1e-9, equal_nan=True)


def test_slope_matches_polyfit_with_gaps(spark):
    vals = [1.0, None, 2.5, 4.0, None, 3.0, 8.0, None, 9.5, 11.0, 12.0, None, 15.0]
    rows = [("M1", T0 + i * MIN, v) for i, v in enumerate(vals)]
    wide = _df(spark, rows, "machine_id string, timestamp timestamp, s double")
    p = pattern.pattern_features(wide, ["s"]).orderBy("timestamp").toPandas()
    for i in range(len(vals)):
        win = [v for v in vals[max(0, i - 9): i + 1] if v is not None]
        exp = np.polyfit(np.arange(len(win)), win, 1)[0] if len(win) >= 3 else 0.0
        assert abs(p["s__ptrend_10"][i] - exp) < 1e-9


def test_fill_forward_backward_across_chunks(spark):
    rows = [("M1", T0 + dt.timedelta(hours=6 * i), v) for i, v in enumerate([None, None, 2.0, None, None, None, 7.0, None])]
    wide = _df(spark, rows, "machine_id string, timestamp timestamp, s double")
    f = rolling.fill_forward_backward(wide, ["s"]).orderBy("timestamp").collect()
    assert [x.s for x in f] == [2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 7.0, 7.0]


# ---------------------------------------------------------------- A1, A3, W12, W14
def test_duplicate_timestamp_is_averaged(spark):
    long = _df(spark, [("M1", T0, "s", 1.0), ("M1", T0, "s", 3.0)],
               "machine_id string, timestamp timestamp, variable_name string, value double")
    assert latest.pivot_wide(long, ["s", "t"]).collect()[0].s == 2.0
    assert latest.dedup_mean(long).collect()[0].value == 2.0


def test_idle_rules(spark):
    rows = [("A", T0 + i * MIN, None) for i in range(6)] + \
           [("B", T0 + i * MIN, 0.5) for i in range(5)] + [("C", T0 + i * MIN, 0.499) for i in range(5)]
    wide = _df(spark, rows, "machine_id string, timestamp timestamp, Cycle_time double")
    got = {r.machine_id: r.is_idle for r in latest.idle_by_last_rows(wide).collect()}
    assert got == {"A": True, "B": False, "C": True}
    x = _df(spark, [(None,), (0.5,), (0.499,)], "c double").select(is_idle("c")).collect()
    assert [r[0] for r in x] == [True, False, True]


# ---------------------------------------------------------------- A10, D6
def test_single_row_sigma_is_zero(spark):
    w = _df(spark, [("M1", "Cycle_time", 10.0)], "machine_id string, variable_name string, value double")
    tol = config.tolerances_df(spark, [("Cycle_time", None, None)])
    r = limits.dynamic_limits(w, tol).collect()[0]
    assert r["std"] == 0.0 and r.min_limit == pytest.approx(9.5) and r.max_limit == pytest.approx(10.5)


def test_root_cause_breach_threshold_and_ties(spark):
    lim = _df(spark, [("M1", "a", 0.0, 100.0, 0), ("M1", "b", 0.0, 100.0, 1), ("M1", "c", 0.0, 100.0, 2)],
              "machine_id string, sensor string, min_limit double, max_limit double, ordinal int")
    cur = _df(spark, [("M1", "a", 100.9), ("M1", "b", 101.0), ("M1", "c", 50.0)],
              "machine_id string, sensor string, value double")
    r = alerts.root_causes(cur, lim).collect()[0]
    # a breaches by 0.9 % (< 1 %): dropped from both lists; b by 1 %: kept
    assert r.breached_sensors == "b" and r.root_causes == "b" and r.n_breached == 1
    cur2 = _df(spark, [("M1", "a", 60.0), ("M1", "b", 40.0), ("M1", "c", 50.0)],
               "machine_id string, sensor string, value double")
    r2 = alerts.root_causes(cur2, lim).collect()[0]
    assert r2.root_causes == "a,b,c" and r2.n_breached == 0  # a and b tie: limit order


# ---------------------------------------------------------------- A18-A21
def _xy(spark, pairs):
    return _df(spark, pairs, "score double, label int")


def test_auc_matches_pairwise_brute_force(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < 0.3).astype(int)
    got = evaluate.roc_auc(_xy(spark, list(zip(s.tolist(), y.tolist())))).collect()[0].auc
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(exp, abs=1e-12)


def test_pr_curve_brute_force_and_stop(spark):
    pairs = [(0.9, 1), (0.8, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 1), (0.4, 0), (0.3, 0)]
    xy = _xy(spark, pairs)
    pr = {r.threshold: r for r in evaluate.pr_curve(xy).collect()}
    for t, r in pr.items():
        sel = [y for s, y in pairs if s >= t]
        assert r.precision == pytest.approx(sum(sel) / len(sel))
        assert r.recall == pytest.approx(sum(sel) / 4)
    assert min(pr) == 0.5   # the highest threshold already at full recall
    b = evaluate.best_threshold(evaluate.pr_curve(xy), stop_precision=0.75).collect()[0]
    # ascending: 0.5 (p=.667, f1=.8), 0.6 (f1=.667), 0.7 (p=.75 -> stop, included)
    assert b.best_threshold == 0.5 and b.best_f1 == pytest.approx(0.8)
    b2 = evaluate.best_threshold(evaluate.pr_curve(xy), stop_precision=0.6).collect()[0]
    assert b2.best_threshold == 0.5   # stops at the first threshold
    bk = evaluate.precision_buckets(evaluate.pr_curve(xy), stop_precision=0.75).collect()
    assert [(r.threshold, r.bucket) for r in bk] == [(0.5, 65), (0.7, 75)]


def test_confusion_at_threshold(spark):
    xy = _xy(spark, [(0.5, 1), (0.49, 1), (0.7, 0), (0.1, 0)])
    r = evaluate.confusion(xy, threshold=0.5).collect()[0]
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1)
    r2 = evaluate.confusion(xy, threshold=0.5, op=">").collect()[0]
    assert (r2.tp, r2.fp) == (0, 1)


# ---------------------------------------------------------------- order statistics, samples
def test_global_quantile_matches_numpy(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=1001) * 100
    df = _df(spark, [(float(x), int(i % 3)) for i, x in enumerate(v)], "v double, g int")
    for p in (0.01, 0.5, 0.75, 0.99):
        got = stats.global_quantile(df, "v", p).collect()[0].q
        assert got == pytest.approx(np.quantile(v, p), rel=1e-12)
    per = {r.g: r.q for r in stats.global_quantile(df, "v", 0.5, keys=["g"]).collect()}
    for g in range(3):
        assert per[g] == pytest.approx(np.quantile(v[np.arange(1001) % 3 == g], 0.5), rel=1e-12)


def test_hash_samples_exact_and_deterministic(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = sampling.stratified_downsample(df, "label", ["id"], max_rows=1000, min_pos=50)
    got = {r.label: r["count"] for r in s.groupBy("label").count().collect()}
    assert got == {1: 100, 0: 900}
    again = sampling.stratified_downsample(df, "label", ["id"], max_rows=1000, min_pos=50)
    assert sorted(r.id for r in s.collect()) == sorted(r.id for r in again.collect())
    sp = sampling.stratified_split(df, "label", ["id"], 0.2)
    c = {tuple(r[:2]): r[2] for r in sp.groupBy("label", "split").count().collect()}
    assert c == {(0, "TEST"): 900, (0, "TRAIN"): 3600, (1, "TEST"): 100, (1, "TRAIN"): 400}


def test_temporal_split_disjoint_and_complete(spark):
    df = spark.range(1000).select(F.col("id"), F.timestamp_seconds(F.col("id") * 977).alias("ts"))
    s = sampling.temporal_split(df, ["ts", "id"])
    rows = s.collect()
    assert len(rows) == 1000
    train = sorted(r.id for r in rows if r.split == "TRAIN")
    assert train == list(range(800))


def test_union_distinct_idempotent(spark):
    df = _df(spark, [(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    once = df.union(df).distinct()
    twice = once.union(df).distinct()
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b")]


# ---------------------------------------------------------------- empty inputs
def test_empty_inputs(spark):
    long = _df(spark, [], "machine_id string, variable_name string, timestamp timestamp, value double")
    assert rolling.rolling_time_long(long, [("x", 60)], min_periods=1).count() == 0
    assert latest.latest_values(long).count() == 0
    lim = config.limits_df(spark, config.FIXTURE_LIMITS)
    assert limits.violations(latest.latest_values(long), lim).count() == 0
    ev = _df(spark, [], "machine_id string, event_ts timestamp")
    assert asof.asof_label(long, ev, label="y").count() == 0
    xy = _xy(spark, [])
    assert evaluate.roc_auc(xy).collect()[0].auc == 0.0


def test_live_rolling_cap_binds(spark):
    """W4 with a small cap: frame = last `cap` rows when the time frame holds more."""
    rng = np.random.default_rng(21)
    n, cap, w = 60, 5, 600
    ts = [T0 + dt.timedelta(seconds=int(x)) for x in np.sort(rng.choice(3000, n, replace=False))]
    vals = [float(v) if i % 4 else None for i, v in enumerate(rng.normal(size=n))]
    wide = _df(spark, [("M1", t, v) for t, v in zip(ts, vals)], "machine_id string, timestamp timestamp, s double")
    got = rolling.rolling_live(wide, ["s"], w, cap=cap, min_rows=1, name="x").orderBy("timestamp").collect()
    for i, r in enumerate(got):
        in_t = [j for j in range(i + 1) if (ts[i] - ts[j]).total_seconds() <= w]
        frame = [j for j in in_t if j > i - cap]
        v = [vals[j] for j in frame if vals[j] is not None]
        assert r.frame_rows == len(frame)
        if v:
            assert r["s__mean_x"] == pytest.approx(np.mean(v))
            assert r["s__max_x"] == max(v) and r["s__last_x"] == v[-1]
        else:
            assert r["s__mean_x"] is None


# --- A17: files of different columns ------------------------------------------

def test_csv_coverage_of_files_with_different_columns(spark, tmp_path):
    from moldwatch.sources.files import csv_file_coverage
    files = {
        "M1-a.csv": 'timestamp,value,variable_name\n2024-01-02T00:00:00Z,1,x\n\n2024-01-01T00:00:00Z,2,"a,b"\n',
        "M1-b.csv": '"Value, raw","Sample ""UTC"" Time",id\n"1,5",2024-03-01 10:00:00,7\n"2,5",bad,8\n',
        "M2-a.csv": "a,b\n1,2\n3,4\n5,6\n",
        "M2-b.csv": "\ufeffTime,b\n",
        "M3-a.csv": "x,time\n1\n",
        "M4-a.csv": "",
        "skipped.txt": "time\n2024-01-01\n"}
    (tmp_path / "deep").mkdir()
    for i, (name, text) in enumerate(files.items()):
        (tmp_path / ("deep" if i % 2 else ".") / name).write_text(text, encoding="utf-8")
    found = {r["source_file"]: (str(r["first_ts"]), str(r["last_ts"]), r["rows"], r["n_columns"], r["columns"])
             for r in csv_file_coverage(spark, str(tmp_path)).collect()}
    assert found == {
        "M1-a.csv": ("2024-01-01 00:00:00", "2024-01-02 00:00:00", 2, 3, ["timestamp", "value", "variable_name"]),
        "M1-b.csv": ("2024-03-01 10:00:00", "2024-03-01 10:00:00", 2, 3, ["Value, raw", 'Sample "UTC" Time', "id"]),
        "M2-a.csv": ("None", "None", 3, 2, ["a", "b"]),
        "M2-b.csv": ("None", "None", 0, 2, ["Time", "b"]),
        "M3-a.csv": ("None", "None", 1, 2, ["x", "time"])}


def test_csv_coverage_of_a_file_in_many_splits(spark, tmp_path):
    from moldwatch.sources.files import csv_file_coverage
    rows = [f"{i},2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z" for i in range(5000)]
    (tmp_path / "M1-a.csv").write_text("\n".join(["id,time", *rows]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        c = csv_file_coverage(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["rows"], r["columns"], str(r["first_ts"]), str(r["last_ts"])) for r in c] == [
        (5000, ["id", "time"], "2024-01-01 00:00:00", "2024-01-01 01:23:19")]


# --- E1: codes from ranges ----------------------------------------------------

def test_label_codes_over_many_ranges(spark):
    from moldwatch.operators.encode import fit_label_encoding
    values = [f"common prefix {i:05d}" for i in range(2000)] + ["", "é", "Z", "a", "😀"]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "part string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["value"]: r["code"] for r in fit_label_encoding(df, "part").collect()}
        assert fit_label_encoding(df.where("part is null"), "part").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert found == {v: i for i, v in enumerate(sorted(set(values), key=lambda v: v.encode()))}
