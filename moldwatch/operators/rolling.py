"""Rolling features (W1-W4), fills (W10), lags.

Frames follow the four definitions in use:
  W1 rows      : last n rows per machine (rows with a NULL still count as
                 positions); a stat needs >= min_periods non-NULL values.
  W2 time      : (t - w, t] per (machine, sensor) over non-NULL readings,
                 min_periods on the count.               [default]
  W3 serving   : W2 on forward/back-filled wide rows, min_periods 1,
                 std NULL -> 0.
  W4 live      : [t - w, t], at most the last ``cap`` rows, < 3 rows -> no
                 features, std NULL -> 0, last = last non-NULL in frame.
All run over halo chunks (see ``chunking``), with statistics that do not
re-aggregate the frame for every row (see ``frames``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.operators.chunking import row_chunked, time_chunked
from moldwatch.operators.frames import Frame, framed

STATS = ("mean", "std", "min", "max", "last")


def _picked(value: str, frame: str, stat: str, min_periods: int = 1) -> Column:
    """A statistic where the frame holds at least ``min_periods`` values."""
    return F.when(F.col(f"{value}__n_{frame}") >= min_periods, F.col(f"{value}__{stat}_{frame}"))


def rolling_time_long(long_df: DataFrame, windows, keys=("machine_id", "variable_name"),
                      ts: str = "timestamp", value: str = "value", min_periods: int = 20,
                      stats=STATS, closed: str = "right", chunk_us: int | None = None
                      ) -> DataFrame:
    """Long rolling table (keys, window, timestamp, mean, std, min, max, last).

    ``windows``: [(name, seconds)].  Frame (t - w, t] (``closed='right'``) or
    [t - w, t] (``closed='both'``).  Input must have one row per (keys, ts)
    (dedup with ``dedup_mean`` first: RANGE frames include peers).
    """
    keys = list(keys)
    wmax = max(s for _, s in windows) * 1_000_000
    chunk_us = chunk_us or max(4 * wmax, 3_600_000_000)
    x = time_chunked(long_df.where(F.col(value).isNotNull()), ts, behind_us=wmax,
                     chunk_us=chunk_us)
    frames = [Frame(name, us=secs * 1_000_000, closed=closed != "right") for name, secs in windows]
    x = framed(x.withColumn("_v", F.col(value).cast("double")), [*keys, "_chunk"], "_t", ["_v"], frames, [*keys, ts, "_v"])
    per_window = [F.struct(F.lit(f.name).alias("window"),
                           *[F.when(F.col(f"_v__n_{f.name}") >= min_periods,
                                    F.col("_v") if st == "last" else F.col(f"_v__{st}_{f.name}")).alias(st) for st in stats])
                  for f in frames]
    out = x.select(*keys, ts, F.explode(F.array(*per_window)).alias("_s"))
    return out.select(*keys, F.col("_s.window").alias("window"), ts,
                      *[F.col(f"_s.{s}").alias(s) for s in stats])


def long_to_wide_features(long_feats: DataFrame, sensors, windows, keys=("machine_id",),
                          ts: str = "timestamp", stats=STATS) -> DataFrame:
    """Long rolling table -> wide ``{sensor}__{stat}_{window}`` (one pivot).

    One hash aggregate of conditional maxima: Spark's pivot aggregates twice, and its second pass, one cell at a
    time, took most of the table's time.  Equal readings at one time have equal frames, the largest ``last`` counts.
    """
    names = [f"{s}|{w}" for s in sensors for w, _ in windows]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.concat_ws("|", "variable_name", "window"))
    tagged = long_feats.select(*keys, ts, place.alias("_k"), *stats)
    cells = [(f"{s}__{st}_{w}", len(windows) * i + j + 1, st) for i, s in enumerate(sensors) for j, (w, _) in enumerate(windows) for st in stats]
    return tagged.groupBy(*keys, ts).agg(*[F.max(F.when(F.col("_k") == k, F.col(st))).alias(name) for name, k, st in cells])


def rolling_rows_wide(wide: DataFrame, sensors, windows, keys=("machine_id",),
                      ts: str = "timestamp", stats=STATS, chunk_rows: int | None = None
                      ) -> DataFrame:
    """Row-count rolling on a wide table per machine.

    ``windows``: [(name, n_rows)]; min_periods = max(3, n // 10); the frame
    counts rows (NULLs occupy positions), the stats count non-NULLs.  Rows
    are numbered per machine with the two-level index and chunked with a
    row halo of max(n) - 1, so a long machine is split across tasks.
    """
    keys = list(keys)
    nmax = max(n for _, n in windows)
    x = row_chunked(wide, keys, ts, behind_rows=nmax - 1,
                    chunk_rows=chunk_rows or max(20 * nmax, 4000))
    x = framed(x, [*keys, "_chunk"], "_idx", sensors, [Frame(name, rows=n) for name, n in windows], [*keys, ts, *sensors])
    cols = [F.when(F.col(f"{s}__n_{name}") >= max(3, n // 10), F.col(s)).alias(f"{s}__last_{name}") if k == "last"
            else _picked(s, name, k, max(3, n // 10)).alias(f"{s}__{k}_{name}")
            for s in sensors for name, n in windows for k in stats]
    return x.select(*keys, ts, *cols)


def fill_forward_backward(wide: DataFrame, cols, keys=("machine_id",), ts: str = "timestamp",
                          backward: bool = True, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Forward fill then back fill per machine.

    Two-level: within (machine, day chunk) a running ``last(ignorenulls)``;
    the carry-in from earlier chunks comes from a small per-chunk table of
    last non-NULL values, so no task holds a machine's whole history.
    """
    keys = list(keys)
    x = wide.withColumn("_c", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / chunk_us)
                        .cast("long"))
    per_chunk = x.groupBy(*keys, "_c").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_l_{c}")
          for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_f_{c}")
          for c in cols])
    wc = Window.partitionBy(*keys).orderBy("_c")
    carry = per_chunk.select(
        *keys, "_c",
        *[F.last(f"_l_{c}", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1))
          .alias(f"_cf_{c}") for c in cols],
        *[F.first(f"_f_{c}", ignorenulls=True).over(wc.rowsBetween(1, Window.unboundedFollowing))
          .alias(f"_cb_{c}") for c in cols])
    y = x.join(carry, keys + ["_c"], "left")
    wf = Window.partitionBy(*keys, "_c").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys, "_c").orderBy(F.col(ts).desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in cols:
        f = F.coalesce(F.last(c, ignorenulls=True).over(wf), F.col(f"_cf_{c}"))
        if backward:
            b = F.coalesce(F.last(c, ignorenulls=True).over(wb), F.col(f"_cb_{c}"))
            f = F.coalesce(f, b)
        out.append(f.alias(c))
    return y.select(*[F.col(c) for c in wide.columns if c not in cols], *out) \
        .select(*wide.columns)


def rolling_serving(wide: DataFrame, sensors, windows, keys=("machine_id",),
                    ts: str = "timestamp", stats=STATS, chunk_us: int | None = None
                    ) -> DataFrame:
    """Time frame (t - w, t] on ffill/bfill'ed wide rows, min_periods 1,
    std NULL -> 0, last = filled value."""
    keys = list(keys)
    filled = fill_forward_backward(wide, sensors, keys, ts)
    wmax = max(s for _, s in windows) * 1_000_000
    # a group has all sensors of its chunk: two windows and the halo, where one sensor's chunk has four
    x = time_chunked(filled, ts, behind_us=wmax, chunk_us=chunk_us or max(2 * wmax, 3_600_000_000))
    frames = [Frame(name, us=secs * 1_000_000) for name, secs in windows]
    x = framed(x, [*keys, "_chunk"], "_t", sensors, frames, [*keys, ts, *sensors])
    cols = []
    for s in sensors:
        for name, _ in windows:
            vals = {"mean": _picked(s, name, "mean"), "min": _picked(s, name, "min"), "max": _picked(s, name, "max"),
                    "std": F.when(F.col(f"{s}__n_{name}") >= 1, F.coalesce(F.col(f"{s}__std_{name}"), F.lit(0.0))),
                    "last": F.when(F.col(f"{s}__n_{name}") >= 1, F.col(s))}
            cols += [vals[k].alias(f"{s}__{k}_{name}") for k in stats]
    return x.select(*keys, ts, *cols)


def rolling_live(wide: DataFrame, sensors, window_s: int, keys=("machine_id",),
                 ts: str = "timestamp", cap: int | None = None, min_rows: int = 3, name: str = "5m"
                 ) -> DataFrame:
    """Closed frame [t - w, t], intersected with the last ``cap`` rows if a
    buffer length is given: both frames end at the current row, so that is
    whichever holds fewer rows.  Time or row halo chunks bound every group."""
    keys = list(keys)
    w_us = window_s * 1_000_000
    if cap is None:
        x = time_chunked(wide, ts, behind_us=w_us, chunk_us=max(4 * w_us, 3_600_000_000))
    else:
        x = row_chunked(wide, keys, ts, behind_rows=cap, chunk_rows=max(4 * cap, 4000))
        x = x.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    x = framed(x, [*keys, "_chunk"], "_t", sensors, [Frame(name, us=w_us, rows=cap, closed=True)], [*keys, ts])
    rows = F.col(f"frame_rows_{name}")
    out = [rows.alias("frame_rows")]
    for s in sensors:
        for k in STATS:
            c = F.col(f"{s}__{k}_{name}")
            if k == "std":
                c = F.coalesce(c, F.when(F.col(f"{s}__n_{name}") >= 1, F.lit(0.0)))
            out.append(F.when(rows >= min_rows, c).alias(f"{s}__{k}_{name}"))
    return x.select(*keys, ts, *out)


def rolling_buffered(readings: DataFrame, sensors, window_s: int, cap: int, min_rows: int = 3,
                     chunk_rows: int | None = None) -> DataFrame:
    """L4 over a batch of readings (machine_id, variable_name, value, timestamp, seq), as
    ``streaming.live.live_rolling_stream`` gives them one by one: the buffer is the machine's last ``cap``
    readings in (timestamp, seq) order, of any sensor.  Per reading with at least ``min_rows`` buffered and per sensor of ``sensors``
    in the buffer: statistics of its values with t >= now - window; without any, its last
    buffered value with std 0.  Readings without machine or time are left out; a null value
    holds a place in the buffer.  Row-halo chunks, so a machine is as many groups as it has
    chunks, and each holds at most ``cap`` rows more than its own."""
    values = {f"_s{i}": s for i, s in enumerate(sensors)}
    x = readings.where(F.col("machine_id").isNotNull() & F.col("timestamp").isNotNull()).select(
        "machine_id", "seq", "timestamp",
        *[F.when(F.col("variable_name") == s, F.col("value")).alias(c) for c, s in values.items()])
    x = row_chunked(x, ["machine_id"], "timestamp", behind_rows=cap, chunk_rows=chunk_rows or max(4 * cap, 4000), tie="seq")
    x = x.withColumn("_t", F.unix_micros("timestamp"))
    frames = [Frame("w", us=window_s * 1_000_000, rows=cap, closed=True, to_own=True), Frame("buf", rows=cap)]
    x = framed(x, ["machine_id", "_chunk"], "_t", list(values), frames, ["machine_id", "seq", "timestamp"], tie="_idx")
    each = F.explode(F.array(*[F.struct(
        F.lit(s).alias("sensor"), *[F.coalesce(f"{c}__{k}_w", f"{c}__last_buf").alias(k) for k in ("mean", "min", "max")],
        F.coalesce(F.col(f"{c}__std_w"), F.lit(0.0)).alias("std"), F.col(f"{c}__last_buf").alias("last"))
        for c, s in values.items()]))
    return (x.where(F.col("frame_rows_buf") >= min_rows).select("machine_id", "seq", "timestamp", each.alias("_f"))
            .where(F.col("_f.last").isNotNull())
            .select("machine_id", "seq", "timestamp", *[F.col(f"_f.{k}").alias(k) for k in ("sensor", "mean", "std", "min", "max", "last")]))


def lag_features(wide: DataFrame, sensors, k: int, keys=("machine_id",), ts: str = "timestamp",
                 target_lead: bool = True, drop_nulls: bool = True, chunk_rows: int = 4000
                 ) -> DataFrame:
    """Lags 1..k of every sensor and the lead(1) target, per machine
    (never across machines); rows with any NULL dropped.  Row-halo chunked."""
    keys = list(keys)
    x = row_chunked(wide, keys, ts, behind_rows=k, ahead_rows=1 if target_lead else 0,
                    chunk_rows=chunk_rows)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_idx")
    cols = [F.col(s) for s in sensors]
    for s in sensors:
        for i in range(1, k + 1):
            cols.append(F.lag(s, i).over(w).alias(f"{s}_lag{i}"))
        if target_lead:
            cols.append(F.lead(s, 1).over(w).alias(f"{s}_next"))
    out = x.select(*keys, ts, "_own", *cols).where("_own").drop("_own")
    return out.dropna() if drop_nulls else out


def master_schema(long_df: DataFrame, windows, stats=STATS, var: str = "variable_name") -> DataFrame:
    """Feature names ``{variable}__{stat}_{window}`` for every distinct
    variable in all rows, sorted by variable, window order, stat order (A27).
    The distinct variable list is an aggregate (one row per variable); the
    window x stat grid is a fixed literal array, exploded per variable."""
    grid = F.array(*[F.struct(F.lit(i * len(stats) + j).alias("k"),
                              F.lit(f"__{st}_{w[0]}").alias("suffix"))
                     for i, w in enumerate(windows) for j, st in enumerate(stats)])
    v = long_df.select(var).distinct()
    x = v.select(var, F.explode(grid).alias("g"))
    w = Window.orderBy(var, "g.k")  # one row per feature name: bounded by the schema size
    return x.select(F.concat(F.col(var), F.col("g.suffix")).alias("feature"),
                    (F.row_number().over(w) - 1).cast("int").alias("position"))
