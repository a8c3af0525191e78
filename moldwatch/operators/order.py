"""Two-level order statistics.

A window over all rows of one key puts that key in one task.  With a hot key
holding a third of the data that task is the job.  These helpers first count
rows per (key, coarse time bucket) -- a partial aggregate, tiny -- locate the
bucket that contains the boundary, and run the exact row-level window only
over rows that can still matter (the last buckets, or one boundary bucket).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _bucket(ts: str, bucket_us: int):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_us)).cast("long")


def last_n_per_key(df: DataFrame, keys, ts: str, n: int, bucket_us: int = HOUR_US,
                   tie: str | None = None, rank_col: str = "_rn") -> DataFrame:
    """Rows ranked 1..n from the end of each key (``rank_col`` = 1 is latest).

    Exact: buckets are summed from the newest backwards until they hold >= n
    rows; only rows in those buckets enter the ``row_number`` window.  Rows with a null key
    or time have no place in this order and are left out.
    """
    keys = list(keys)
    b = df.withColumn("_b", _bucket(ts, bucket_us))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys).orderBy(F.col("_b").desc())
    # rows strictly newer than this bucket; the bucket is needed while < n
    needed = (counts.withColumn("_newer", F.coalesce(F.sum("_c").over(
        wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("_newer") < n)
        .groupBy(*keys).agg(F.min("_b").alias("_bmin")))
    kept = b.join(needed, keys).where(F.col("_b") >= F.col("_bmin")).drop("_bmin")
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return (kept.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= n).drop("_b"))


def global_row_index(df: DataFrame, order_cols, bucket_col: str, index_col: str = "_idx"
                     ) -> DataFrame:
    """0-based global position of each row in ``order_cols`` order.

    ``bucket_col`` must be monotone in the order (e.g. the day of the first
    order column).  Rows are numbered inside their bucket (one window task
    per bucket) and offset by the count of all earlier buckets, computed on
    the small per-bucket count table.  No single-partition global window.
    """
    counts = df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_c")
    w = Window.partitionBy(bucket_col).orderBy(*order_cols)
    return (df.join(offsets, bucket_col)
            .withColumn(index_col, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_off"))


def keyed_row_index(df: DataFrame, keys, ts: str, bucket_us: int = HOUR_US,
                    tie: str | None = None, index_col: str = "_idx") -> DataFrame:
    """0-based position of each row inside its key in (ts, tie) order.

    Same two-level scheme as ``global_row_index``, per key: per-(key, bucket)
    counts give each bucket's offset; ``row_number`` runs per (key, bucket),
    so a hot key is spread over as many tasks as it has buckets.  Rows with a null key or
    time have no place in this order and are left out.
    """
    keys = list(keys)
    b = df.withColumn("_b", _bucket(ts, bucket_us))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_c")
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (b.join(offsets, keys + ["_b"])
            .withColumn(index_col, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_off", "_b"))
