"""Sort, top-k, downsampling, splitting and sampling."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_keep(df: DataFrame, keys, order, keep: str = "first") -> DataFrame:
    """Drop duplicates on ``keys`` keeping the first / last row in ``order``.

    A grouped ``min_by``/``max_by`` over a struct of the row: partial
    aggregation, so duplicates collapse map-side before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordv = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[F.col(c) for c in rest])
    agg = F.min_by(packed, ordv) if keep == "first" else F.max_by(packed, ordv)
    return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def _indexed(df: DataFrame, keys, ts: str, tie: str | None):
    from moldwatch.operators.order import keyed_row_index
    keys = list(keys)
    x = keyed_row_index(df, keys, ts, tie=tie, index_col="_idx")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return x.join(n, keys)


def downsample_stride(df: DataFrame, max_points: int, keys=("machine_id",), ts: str = "timestamp",
                      tie: str | None = None) -> DataFrame:
    """Every ceil(n / max)-th row per key plus always the last row.

    Positions come from the two-level per-key index and the per-key count
    is an aggregate joined back, so a long series is never one task.  Of the
    kept points with the same key and timestamp the last one stays.
    """
    x = _indexed(df, keys, ts, tie)
    step = F.ceil(F.col("_n") / F.lit(float(max_points))).cast("long")
    keep = (F.col("_n") <= max_points) | (F.col("_idx") % step == 0) | (F.col("_idx") == F.col("_n") - 1)
    return dedup_keep(x.where(keep), [*keys, ts], order=["_idx"], keep="last").drop("_idx", "_n")


def stride_every(df: DataFrame, step: int, min_rows: int, keys=("machine_id",),
                 ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Every ``step``-th row per key when the key has more than ``min_rows``."""
    x = _indexed(df, keys, ts, tie)
    return x.where((F.col("_n") <= min_rows) | (F.col("_idx") % step == 0)).drop("_idx", "_n")


def recent_tail(df: DataFrame, n: int, keys=("machine_id",), ts: str = "timestamp",
                tie: str | None = None) -> DataFrame:
    """The last ``n`` rows per key, ``tail_rank`` 1 = newest."""
    from moldwatch.operators.order import last_n_per_key
    return last_n_per_key(df, keys, ts, n, tie=tie, rank_col="tail_rank")


def temporal_split(df: DataFrame, order_cols, train_fraction: float = 0.8, ts: str | None = None,
                   out: str = "split") -> DataFrame:
    """Chronological split by row position: the first int(n * f) rows in
    ``order_cols`` order are TRAIN, the rest TEST (F4).

    Exact and distributed: rows are counted per hour, whole hours lie before or
    after the cut, and only the rows of the hour that holds it are ranked.  Rows without a
    time are kept too: they come after all others, as an hour of their own.
    """
    ts = ts or order_cols[0]
    x = df.withColumn("_part", F.date_trunc("hour", F.col(ts).cast("timestamp")))
    counts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # one row per hour
    cut = F.floor(counts.agg(F.sum("_c")).scalar() * F.lit(train_fraction))
    before = Window.orderBy(F.col("_part").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(F.col("_part").alias("_hour"), "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), cut.alias("_cut"))
    x = x.join(parts, F.col("_part").eqNullSafe(F.col("_hour"))).drop("_hour")
    edge = (F.col("_off") < F.col("_cut")) & (F.col("_cut") < F.col("_off") + F.col("_c"))
    w = Window.partitionBy("_part").orderBy(*[F.col(c) for c in order_cols])
    ranked = x.where(edge).withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1)
    both = x.where(~edge).withColumn("_pos", F.col("_off")).unionByName(ranked)
    return both.withColumn(out, F.when(F.col("_pos") < F.col("_cut"), "TRAIN").otherwise("TEST")) \
        .drop("_part", "_c", "_off", "_cut", "_pos")


def _hash_u(key_cols, seed: int):
    """Seeded digest of the key as text: the same in any engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols], F.lit(str(seed))))


def hash_rank_take(df: DataFrame, class_cols, quota: DataFrame, key_cols, seed: int = 42,
                   out: str | None = None) -> DataFrame:
    """Per class, the ``n`` rows with the smallest seeded hash of their key
    (a deterministic uniform sample of exact size).

    ``quota``: class_cols + ``n``.  Two levels: rows are counted per (class,
    first 5 digits of the digest) -- a small table -- so whole buckets are kept or
    dropped by their running offset, and only the rows of the one boundary bucket
    per class are sorted and ranked.  With ``out`` all rows are returned and
    ``out`` flags the chosen ones instead of filtering.
    """
    class_cols = list(class_cols)
    x = df.withColumn("_u", _hash_u(key_cols, seed)) \
        .withColumn("_hb", F.substring("_u", 1, 5))
    counts = x.groupBy(*class_cols, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*class_cols).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))) \
        .join(quota.select(*class_cols, F.col("n").alias("_q")), class_cols)
    y = x.join(offs, [*class_cols, "_hb"], "left")
    full = F.col("_off") + F.col("_c") <= F.col("_q")
    boundary = (F.col("_off") < F.col("_q")) & ~full
    wr = Window.partitionBy(*class_cols, "_hb").orderBy("_u", *[F.col(c) for c in key_cols])
    edge = F.coalesce(boundary, F.lit(False))
    ranked = y.where(edge).withColumn("_rk", F.row_number().over(wr))
    ranked = ranked.withColumn("_keep", F.col("_off") + F.col("_rk") <= F.col("_q")).drop("_rk")
    whole = y.where(~edge).withColumn("_keep", F.coalesce(full, F.lit(False)))
    both = whole.unionByName(ranked).drop("_u", "_hb", "_c", "_off", "_q")
    return both.withColumnRenamed("_keep", out) if out else both.where("_keep").drop("_keep")


def stratified_split(df: DataFrame, label: str, key_cols, test_fraction: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Seeded stratified split: round(f * n_class) TEST rows per class."""
    quota = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * test_fraction).cast("long").alias("n"))
    x = hash_rank_take(df, [label], quota, key_cols, seed, out="_test")
    return x.withColumn(out, F.when(F.col("_test"), "TEST").otherwise("TRAIN")).drop("_test")


def stratified_downsample(df: DataFrame, label: str, key_cols, max_rows: int,
                          min_pos: int = 1000, keys=(), seed: int = 42) -> DataFrame:
    """Stratified downsample to ``max_rows`` per key set (F7; F8 with
    ``keys=('machine_id',)``, 250,000 rows and ``min_pos=2000``).

    n_pos = max(int(P * r), min(P, min_pos)) with r = max_rows / n, at most P and
    ``max_rows``; n_neg = max_rows - n_pos, at most the negatives there are; key sets
    with n <= max_rows are kept whole.  ``max_rows`` bounds the labelled rows that a
    classifier is fitted on.  Rows are chosen by seeded hash rank (exact counts).
    """
    if min_pos >= max_rows:
        raise ValueError("min_pos must leave room for negatives")
    keys = list(keys)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                F.sum((F.col(label) == 1).cast("long")).alias("_P"))
    r = F.lit(float(max_rows)) / F.col("_n")
    n_pos = F.greatest(F.floor(F.col("_P") * r), F.least(F.col("_P"), F.lit(min_pos)))
    n_pos = F.least(F.col("_P"), n_pos, F.lit(max_rows))
    n_pos = F.when(F.col("_n") <= max_rows, F.col("_P")).otherwise(n_pos)
    n_neg = F.when(F.col("_n") <= max_rows, F.col("_n") - F.col("_P")).otherwise(F.lit(max_rows) - n_pos)
    q = cnt.select(*keys, n_pos.cast("long").alias("_pos_n"), n_neg.cast("long").alias("_neg_n"))
    quota = q.select(*keys, F.lit(1).alias(label), F.col("_pos_n").alias("n")).unionByName(
        q.select(*keys, F.lit(0).alias(label), F.col("_neg_n").alias("n")))
    x = df.withColumn(label, F.col(label).cast("int"))
    quota = quota.withColumn(label, F.col(label).cast("int"))
    return hash_rank_take(x, [*keys, label], quota, key_cols, seed)


def structured_sample(long_feats: DataFrame, label: str = "early_scrap_risk",
                      keys=("machine_id", "variable_name"), ts: str = "timestamp",
                      radius_us: int = 30 * 60_000_000, bucket_s: int = 90,
                      group=("machine_id", "variable_name", "window")) -> DataFrame:
    """risky rows U context rows (+-radius, same machine and variable, any
    window) U the first row of every stable (machine, variable, window,
    90 s bucket) group -- first non-NULL value per column, in time order --
    then a full-row distinct (F6, J3, U2)."""
    from moldwatch.operators.asof import context_rows
    cols = long_feats.columns
    ctx = context_rows(long_feats, label, by=keys, ts=ts, radius_us=radius_us)
    risky_or_ctx = ctx.where((F.col(label) == 1) | F.col("in_context")).select(*cols)
    stable = long_feats.where(F.col(label) == 0).withColumn(
        "_bk", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_s * 1_000_000)))
    others = [c for c in cols if c not in group]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in others]
    stable_first = stable.groupBy(*group, "_bk").agg(*firsts).select(*cols)
    return risky_or_ctx.unionByName(stable_first).distinct()


def union_all(frames) -> DataFrame:
    """UNION ALL by column name, missing columns NULL."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def conform(df: DataFrame, columns, fill=None) -> DataFrame:
    """Select ``columns`` in order; missing ones as NULL (U4) or ``fill`` (P20)."""
    have = set(df.columns)
    out = []
    for c in columns:
        if c in have:
            out.append(F.coalesce(F.col(c), F.lit(fill)).alias(c) if fill is not None else F.col(c))
        else:
            out.append(F.lit(fill).cast("double").alias(c))
    return df.select(*out)


def append_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """History rows + future rows with an ``is_future`` flag."""
    return union_all([history.withColumn("is_future", F.lit(False)),
                      future.withColumn("is_future", F.lit(True))])
