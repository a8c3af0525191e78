"""Sliding-frame statistics against pandas, chunked and whole, far from zero too."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moldwatch.operators import frames
from moldwatch.operators.pattern import pattern_features
from moldwatch.operators.rolling import rolling_live, rolling_rows_wide, rolling_serving, rolling_time_long


def series(offset, n=400, seed=0):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.integers(1, 90, n))
    v = offset + rng.normal(0, 1, n).round(2)
    v[100:140] = offset + 3.25  # constant stretch: variance exactly 0
    return pd.DataFrame({"s": t, "x": v})


@pytest.fixture(params=[0.0, 1e9])
def wide(request):
    d = series(request.param)
    d.loc[::7, "x"] = np.nan
    return d


def spark_wide(spark, d):
    rows = [("M1", int(s), None if np.isnan(x) else float(x)) for s, x in zip(d.s, d.x)]
    return spark.createDataFrame(rows, "machine_id string, s bigint, x double").select(
        "machine_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("timestamp"), "x")


def compare(got, want):
    assert len(got) == len(want)
    for c in want.columns:
        g, w = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.array_equal(np.isnan(g), np.isnan(w)), c
        assert np.allclose(g, w, rtol=1e-12, atol=1e-6, equal_nan=True), (c, np.nanmax(np.abs(g - w)))


def exact(d, lo_of, min_periods):
    """Frame statistics computed one frame at a time."""
    x = d.x.to_numpy()
    rows = []
    for i in range(len(d)):
        v = x[lo_of(i):i + 1]
        v = v[~np.isnan(v)]
        ok = len(v) >= min_periods
        c = v - v[0] if len(v) else v
        rows.append((v[0] + c.mean() if ok else np.nan, c.std(ddof=1) if ok and len(v) > 1 else np.nan,
                     v.min() if ok else np.nan, v.max() if ok else np.nan))
    return pd.DataFrame(rows, columns=["mean", "std", "min", "max"])


@pytest.mark.parametrize("chunk_us", [None, 900_000_000])
def test_published_time_windows(spark, wide, chunk_us):
    d = wide.dropna().reset_index(drop=True)
    long = spark_wide(spark, d).select("machine_id", F.lit("x").alias("variable_name"), "timestamp", F.col("x").alias("value"))
    windows = [("5m", 300), ("15m", 900), ("30m", 1800)]
    got = rolling_time_long(long, windows, chunk_us=chunk_us).orderBy("timestamp").toPandas()
    s = d.s.to_numpy()
    for name, w in windows:
        want = exact(d, lambda i: np.searchsorted(s, s[i] - w, "right"), 20)
        compare(got[got.window == name].reset_index(drop=True)[list(want.columns)], want)
    last = got[got.window == "30m"]["last"]
    assert 0 < last.notna().sum() < len(last)


def test_row_windows_chunked_and_whole(spark, wide):
    df = spark_wide(spark, wide)
    want = exact(wide, lambda i: max(0, i - 29), 3)
    for chunk in (None, 37):
        got = rolling_rows_wide(df, ["x"], [("30", 30)], chunk_rows=chunk).orderBy("timestamp").toPandas()
        compare(got.rename(columns=lambda c: c.replace("x__", "").replace("_30", ""))[list(want.columns)], want)


def test_serving_windows(spark, wide):
    filled = wide.ffill().bfill()
    got = rolling_serving(spark_wide(spark, wide), ["x"], [("10m", 600)], chunk_us=1_200_000_000).orderBy("timestamp").toPandas()
    s = filled.s.to_numpy()
    want = exact(filled, lambda i: np.searchsorted(s, s[i] - 600, "right"), 1).fillna({"std": 0.0})
    compare(got.rename(columns=lambda c: c.replace("x__", "").replace("_10m", ""))[list(want.columns)], want)


@pytest.mark.parametrize("cap", [None, 4])
def test_live_windows(spark, wide, cap):
    got = rolling_live(spark_wide(spark, wide), ["x"], 300, cap=cap).orderBy("timestamp").toPandas()
    s, x = wide.s.to_numpy(), wide.x.to_numpy()
    for i in range(len(s)):
        lo = np.searchsorted(s, s[i] - 300, "left")
        lo = max(lo, i - cap + 1) if cap else lo
        v = x[lo:i + 1]
        v = v[~np.isnan(v)]
        assert got.frame_rows[i] == i + 1 - lo
        if i + 1 - lo >= 3 and len(v):
            assert np.isclose(got["x__mean_5m"][i], v.mean(), rtol=1e-12) and got["x__last_5m"][i] == v[-1]
        else:
            assert np.isnan(got["x__mean_5m"][i])


def test_slopes(spark, wide):
    got = pattern_features(spark_wide(spark, wide), ["x"], chunk_rows=50).orderBy("timestamp").toPandas()
    x = wide.x.to_numpy()
    for i in range(len(x)):
        v = x[max(0, i - 9):i + 1]
        v = v[~np.isnan(v)]
        want = np.polyfit(np.arange(len(v)), v - v[0], 1)[0] if len(v) >= 3 else 0.0
        assert np.isclose(got["x__ptrend_10"][i], want, atol=1e-6)


def test_constant_frames_have_no_spread():
    x = np.full((300, 1), 1e9 + 0.1)
    lo = np.maximum(np.arange(300) - 50, 0)
    n, mean, spread, least, most = frames.frame_stats(x, lo, np.arange(300) + 1)
    assert (spread == 0).all() and (mean == x).all() and (n[:, 0] == np.arange(300) + 1 - lo).all()
    n, *_ = frames.frame_stats(np.full((4, 1), np.nan), np.zeros(4, int), np.arange(4) + 1)
    assert (n == 0).all()


def test_a_group_is_given_out_in_slices(monkeypatch, wide):
    """Frames that begin before a slice are whole, and no frame of results is longer than a slice."""
    held = []

    class Grouped:
        schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.DoubleType())])

        def select(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, fn, schema):
            held.append(fn)

    n = len(wide)
    group = pa.table({"k": ["M1"] * n, "x": wide.x.to_numpy(), "_t": wide.s.to_numpy(), "_own": np.arange(n) >= 50})
    shuffled = group.take(np.random.default_rng(1).permutation(n))
    given = [frames.Frame("rows", rows=25), frames.Frame("time", us=900)]
    made = []
    for size in (10_000, 30):
        monkeypatch.setattr(frames, "SLICE_ROWS", size, raising=False)
        frames.framed(Grouped(), ["k"], "_t", ["x"], given, ["k", "x"], slope_rows=9)
        made.append(list(held[-1](iter(shuffled.to_batches(max_chunksize=64)))))
    whole, sliced = made
    assert len(whole) == 1 and len(sliced) > 5 and max(b.num_rows for b in sliced) <= 30
    compare(pa.Table.from_batches(sliced).to_pandas().drop(columns="k"), pa.Table.from_batches(whole).to_pandas().drop(columns="k"))
