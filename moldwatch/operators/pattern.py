"""Pattern features over the last 10 rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.operators.chunking import row_chunked
from moldwatch.operators.frames import Frame, framed
from moldwatch.operators.stats import global_quantile
from moldwatch.session import materialize


def pattern_features(wide: DataFrame, sensors, keys=("machine_id",), ts: str = "timestamp",
                     n: int = 10, min_periods: int = 3, source: str = "raw",
                     stability: bool = False, chunk_rows: int = 4000) -> DataFrame:
    """Per sensor: rolling std/mean over ``n`` rows (min ``min_periods``
    non-NULL), slope of the non-NULL values against 0..k-1, relative
    deviation ``(x - mean) / (|mean| + 1e-6)``; all NULL -> 0.  With
    ``stability`` also ``is_stable = std < global P75(std)`` (W8/A11).
    ``source='mean_15m'`` reads ``{sensor}__mean_15m`` (W9).
    """
    keys = list(keys)
    src = {s: (s if source == "raw" else f"{s}__{source}") for s in sensors}
    x = row_chunked(wide, keys, ts, behind_rows=n - 1, chunk_rows=chunk_rows)
    named = list(src.values())
    x = framed(x, [*keys, "_chunk"], "_idx", named, [Frame("p", rows=n)], wide.columns, slope_rows=n)
    cols = []
    for s in sensors:
        y, ok = F.col(src[s]), F.col(f"{src[s]}__n_p") >= min_periods
        mean = F.when(ok, F.col(f"{src[s]}__mean_p"))
        cols += [F.when(ok, F.col(f"{src[s]}__std_p")).alias(f"{s}__pstd_{n}"), mean.alias(f"{s}__pmean_{n}"),
                 F.when(ok, F.col(f"{src[s]}__slope")).alias(f"{s}__ptrend_{n}"),
                 ((y - mean) / (F.abs(mean) + F.lit(1e-6))).alias(f"{s}__pdev_{n}")]
    out = x.select(*[F.col(c) for c in wide.columns], *cols)
    if stability:  # read twice: for the thresholds and for the rows
        out = materialize(out)
    pcols = [f"{s}__{k}_{n}" for s in sensors for k in ("pstd", "pmean", "ptrend", "pdev")]
    if stability:
        # One exact quantile job for all sensors: the std columns are
        # unpivoted to (sensor, std) and ranked per sensor; the thresholds
        # are pivoted back into a single row.
        long = out.select(F.explode(F.array(*[
            F.struct(F.lit(s).alias("sensor"), F.col(f"{s}__pstd_{n}").alias("v"))
            for s in sensors])).alias("_x")).select("_x.*")
        thr = global_quantile(long, "v", 0.75, keys=["sensor"], out="q")
        # all thresholds as one map-valued scalar subquery (one row)
        thr_map = thr.agg(F.map_from_entries(F.collect_list(F.struct("sensor", "q")))).scalar()
        for s in sensors:
            out = out.withColumn(f"{s}__is_stable", F.coalesce(
                (F.col(f"{s}__pstd_{n}") < thr_map[F.lit(s)]).cast("int"), F.lit(0)))
    return out.fillna(0.0, subset=pcols)
