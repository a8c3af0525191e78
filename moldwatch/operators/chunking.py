"""Halo chunking: split one key's ordered series into chunks that can be
windowed independently.

A window partitioned by (machine, sensor) sends a whole series to one task.
Here every row gets the chunks whose rows can see it: its own chunk, plus a
neighbour chunk when it lies within the look-back (``behind``) or look-ahead
(``ahead``) of that chunk's rows.  Windowing by (key, chunk) and keeping only
own-chunk rows gives exactly the unchunked result for any frame whose reach
is within ``behind``/``ahead``; the extra data is the halo only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.operators.order import keyed_row_index


def time_chunked(df: DataFrame, ts: str, behind_us: int, ahead_us: int = 0,
                 chunk_us: int = 86_400_000_000, t_col: str = "_t") -> DataFrame:
    """Adds ``_t`` (µs), ``_chunk`` and ``_own``; rows are replicated into
    every chunk containing a row t' with t in [t' - behind, t' + ahead]."""
    if chunk_us <= 0:
        raise ValueError("chunk_us must be positive")
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(F.col(t_col) / F.lit(chunk_us)).cast("long")
    first = F.floor((F.col(t_col) - F.lit(ahead_us)) / F.lit(chunk_us)).cast("long")
    last = F.floor((F.col(t_col) + F.lit(behind_us)) / F.lit(chunk_us)).cast("long")
    return (df.withColumn(t_col, t)
            .withColumn("_chunk", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_chunk") == own))


def row_chunked(df: DataFrame, keys, ts: str, behind_rows: int, ahead_rows: int = 0,
                chunk_rows: int = 100_000, tie: str | None = None) -> DataFrame:
    """Row-count version: adds ``_idx`` (position inside the key, two-level
    numbering), ``_chunk`` and ``_own``."""
    x = keyed_row_index(df, keys, ts, tie=tie, index_col="_idx")
    own = F.floor(F.col("_idx") / F.lit(chunk_rows)).cast("long")
    first = F.floor((F.col("_idx") - F.lit(ahead_rows)) / F.lit(chunk_rows)).cast("long")
    last = F.floor((F.col("_idx") + F.lit(behind_rows)) / F.lit(chunk_rows)).cast("long")
    return (x.withColumn("_chunk", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_chunk") == own))
