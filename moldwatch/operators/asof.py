"""Time-range joins between readings and events.

Spark has no as-of join and plans a pure range condition as a nested loop.
Whether an event lies near a reading (``asof_label``, ``context_rows``) is told by the first and last event per key
and time bucket.  Which one is nearest (``asof_nearest``): both sides are put into *time chunks* of one key: a left row lives in
the chunk of its own timestamp; a right row is copied into every chunk
that contains a left timestamp it can match (at most two when the chunk is at
least as wide as the match interval).  The union is windowed per
(key, chunk) in time order, forwards and backwards: the running last event seen is
the nearest one on that side, and its gap is compared with the tolerance.  Such
frames grow by one row at a time, so the work is linear however many
readings lie in the interval.
So the shuffle key is (key, bucket) or (key, chunk): a machine holding a third of all rows is
spread over all of its chunks, and the only duplication is the thin halo of
right rows near chunk borders.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def _us(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _chunk(us: Column, chunk_us: int) -> Column:
    return F.floor(us / F.lit(chunk_us)).cast("long")


def _chunked_union(left: DataFrame, right: DataFrame, by, left_ts: str, right_ts: str,
                   lo_us: int, hi_us: int, chunk_us: int | None, payload=None) -> DataFrame:
    """Union of left rows (own chunk) and right rows copied to every chunk
    whose left rows t satisfy ``right - t`` in [lo_us, hi_us].  Default
    chunk: 12 match intervals, at least one hour (halo <= 1/12 of the right
    side), so a hot machine spreads over many (machine, chunk) tasks."""
    chunk_us = chunk_us or max(12 * (hi_us - lo_us), HOUR_US)
    if chunk_us < hi_us - lo_us:
        raise ValueError("chunk must be at least as wide as the match interval")
    by = list(by)
    payload = list(payload or [])
    lcols = [c for c in left.columns]
    l = left.select(*[F.col(c) for c in lcols],
                    _us(left_ts).alias("_t"), F.lit(1).alias("_is_left"))
    l = l.withColumn("_chunk", _chunk(F.col("_t"), chunk_us))
    e_us = _us(right_ts)
    first_c = _chunk(e_us - F.lit(hi_us), chunk_us)
    last_c = _chunk(e_us - F.lit(lo_us), chunk_us)
    r = right.select(*[F.col(k) for k in by], e_us.alias("_t"),
                     F.struct(*[F.col(c) for c in payload]).alias("_payload")
                     if payload else F.lit(None).alias("_payload"),
                     F.explode(F.sequence(first_c, last_c)).alias("_chunk"))
    r = r.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c)
                   for c in lcols],
                 "_t", F.lit(0).alias("_is_left"), "_chunk", "_payload")
    l = l.withColumn("_payload", F.lit(None).cast(r.schema["_payload"].dataType))
    return l.unionByName(r)


def asof_label(left: DataFrame, right: DataFrame, by=("machine_id",), left_ts="timestamp",
               right_ts="event_ts", tolerance_us: int = 5 * MINUTE_US, direction: str = "nearest",
               label: str = "label") -> DataFrame:
    """1 if a right row of the same key lies in the match interval, else 0.

    nearest  (J1): right in [t - tol, t + tol] (inclusive both sides)
    forward  (J2): right in (t, t + tol]
    backward     : right in [t - tol, t]

    Left rows pass by a table of one row per key and time bucket: in buckets as wide as the tolerance, the
    first and last right row of t's bucket, the last of the one before and the first of the one after
    decide.  So left rows are neither sorted nor held.
    """
    if direction not in ("nearest", "forward", "backward"):
        raise ValueError(f"unknown direction {direction}")
    by, tol, width = list(by), F.lit(tolerance_us), max(tolerance_us, 1)
    keys = [f"_k{i}" for i in range(len(by))]
    events = right.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], _us(right_ts).alias("_e")).where(F.col("_e").isNotNull())
    seen = events.groupBy(*keys, _bucket(F.col("_e"), width).alias("_b")).agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    none = F.lit(None).cast("long")

    def told(shift, first=none, last=none, before=none, after=none):
        return F.struct((F.col("_b") + shift * width).alias("_at"), first.alias("_first"), last.alias("_last"),
                        before.alias("_before"), after.alias("_after"))

    places = F.array(told(0, first=F.col("_lo"), last=F.col("_hi")), told(1, before=F.col("_hi")), told(-1, after=F.col("_lo")))
    around = seen.select(*keys, F.inline(places)).groupBy(*keys, "_at").agg(
        *[F.max(c).alias(c) for c in ("_first", "_last", "_before", "_after")])  # at most one value each
    x = left.withColumn("_t", _us(left_ts)).withColumn("_b", _bucket(F.col("_t"), width))
    same = F.col("_b") == F.col("_at")
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    t = F.col("_t")
    near = {"nearest": F.col("_first").isNotNull() | (F.col("_before") >= t - tol) | (F.col("_after") <= t + tol),
            "forward": (F.col("_last") > t) | (F.col("_after") <= t + tol),
            "backward": (F.col("_first") <= t) | (F.col("_before") >= t - tol)}[direction]
    x = x.join(around.hint("shuffle_hash"), same, "left").withColumn(label, F.when(near, 1).otherwise(0))
    return x.drop("_t", "_b", "_at", "_first", "_last", "_before", "_after", *keys)


def _bucket(us: Column, width: int) -> Column:
    """Begin of the time bucket, in whole numbers."""
    return us - F.pmod(us, F.lit(width))


def _before(by, *ties) -> Window:
    """From the first row up to this one: the last event in it is at or before it."""
    return Window.partitionBy(*by, "_chunk").orderBy("_t", "_is_left", *ties).rowsBetween(Window.unboundedPreceding, 0)


def _after(by, *ties) -> Window:
    """From the last row back to this one: the last event in it is the first at or after it."""
    return Window.partitionBy(*by, "_chunk").orderBy(F.desc("_t"), "_is_left", *ties).rowsBetween(
        Window.unboundedPreceding, 0)


def asof_nearest(left: DataFrame, right: DataFrame, by=("machine_id",), left_ts="timestamp",
                 right_ts="event_ts", tolerance_us: int = 5 * MINUTE_US, payload=None,
                 chunk_us: int | None = None, prefer: str = "earlier") -> DataFrame:
    """Nearest right row within the tolerance (J1 full row, merge_asof
    'nearest').  Adds ``payload`` columns of the matched right row plus
    ``match_ts`` and ``match_gap_us`` (right - left); NULL when none.  Equal
    gaps on both sides pick the earlier right row (``prefer='earlier'``).
    """
    payload = list(payload or [])
    tol = tolerance_us
    rts = "_rt"
    right2 = right.withColumn(rts, F.col(right_ts))
    u = _chunked_union(left, right2, by, left_ts, right_ts, -tol, tol, chunk_us,
                       payload=payload + [rts])
    ev = F.when(F.col("_is_left") == 0, F.struct(F.col("_t").alias("t"), F.col("_payload").alias("p")))
    prev = F.last(ev, ignorenulls=True).over(_before(by, "_payload"))
    nxt = F.last(ev, ignorenulls=True).over(_after(by, "_payload"))
    x = (u.withColumn("_prev", prev).withColumn("_next", nxt)
         .where(F.col("_is_left") == 1)
         .withColumn("_prev", F.when(F.col("_t") - F.col("_prev.t") <= tol, F.col("_prev")))
         .withColumn("_next", F.when(F.col("_next.t") - F.col("_t") <= tol, F.col("_next"))))
    gp = F.col("_t") - F.col("_prev.t")
    gn = F.col("_next.t") - F.col("_t")
    take_prev = F.col("_prev").isNotNull() & (
        F.col("_next").isNull() | (gp < gn) | ((gp == gn) if prefer == "earlier" else F.lit(False)))
    pick = F.when(take_prev, F.col("_prev")).otherwise(F.col("_next"))
    x = x.withColumn("_m", pick)
    out_cols = [F.col(c) for c in left.columns]
    out_cols += [F.col("_m.p")[c].alias(c) for c in payload]
    out_cols += [F.col("_m.p")[rts].alias("match_ts"),
                 (F.col("_m.t") - F.col("_t")).alias("match_gap_us")]
    return x.select(*out_cols)


def context_rows(df: DataFrame, flag: str, by=("machine_id", "variable_name"), ts="timestamp",
                 radius_us: int = 30 * MINUTE_US, out: str = "in_context") -> DataFrame:
    """Rows within +-radius of a flagged row of the same key, inclusive.

    Flagged rows are the right side, their first and last per key and time bucket (see :func:`asof_label`).
    Returns all rows of ``df`` with boolean ``out``.
    """
    right = df.where(F.col(flag) == 1).select(*by, F.col(ts).alias("_ets"))
    return asof_label(df, right, by=by, left_ts=ts, right_ts="_ets", tolerance_us=radius_us,
                      direction="nearest", label="_ctx") \
        .withColumn(out, F.col("_ctx") == 1).drop("_ctx")
