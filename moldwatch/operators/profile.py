"""Data-quality and profiling reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.operators.chunking import row_chunked
from moldwatch.operators.stats import global_quantile


def status_breakdown(log: DataFrame, status: str = "machine_status_code") -> DataFrame:
    """Rows, scrap and yield sums and scrap % (denominator 0 -> 1, 1 dp) per status (A5)."""
    agg = log.groupBy(status).agg(F.count("scrap_quantity").alias("rows"),
                                  F.sum("scrap_quantity").alias("total_scrap"),
                                  F.sum("yield_quantity").alias("total_yield"))
    den = F.col("total_scrap") + F.col("total_yield")
    den = F.when(den == 0, F.lit(1)).otherwise(den)
    return agg.withColumn("scrap_pct", F.bround(F.col("total_scrap") / den * 100, 1))


def kept_summary(events: DataFrame) -> DataFrame:
    """Count and scrap sum of the kept production events."""
    return events.agg(F.count(F.lit(1)).alias("events"),
                      F.sum("scrap_quantity").alias("total_scrap"))


def probability_distribution(df: DataFrame, prob: str = "scrap_probability", keys=()) -> DataFrame:
    """Mean, max and counts above .3 / .5 / .7."""
    p = F.col(prob)
    aggs = [F.avg(p).alias("mean_prob"), F.max(p).alias("max_prob")] + [
        F.sum((p > t).cast("long")).alias(f"n_above_{int(t * 10)}") for t in (0.3, 0.5, 0.7)]
    return df.groupBy(*keys).agg(*aggs)


def machine_summary(df: DataFrame, keys=("machine_id",), label: str = "is_scrap_actual") -> DataFrame:
    """Rows and scrap sum per machine."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"),
                                 F.sum(label).cast("long").alias("scrap_rows"))


def sampling_step(df: DataFrame, keys=("machine_id",), ts: str = "timestamp",
                  default: int = 60, lo: int = 10, hi: int = 120) -> DataFrame:
    """Median step between consecutive timestamps per machine, rounded and
    clipped to [lo, hi]; fewer than 2 rows -> default (A12).  The previous
    timestamp comes from a 1-row halo window, the median from the bucketed
    exact quantile."""
    keys = list(keys)
    x = row_chunked(df.select(*keys, ts), keys, ts, behind_rows=1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_idx")
    d = x.withColumn("_d", (F.unix_micros(F.col(ts).cast("timestamp"))
                            - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))) / 1e6) \
        .where("_own")
    med = global_quantile(d, "_d", 0.5, keys=keys, out="_med")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(med, keys, "left")
    step = F.least(F.greatest(F.round(F.col("_med")), F.lit(float(lo))), F.lit(float(hi)))
    ok = (F.col("_n") >= 2) & F.col("_med").isNotNull() & (F.col("_med") > 0)
    return j.select(*keys, F.when(ok, step).otherwise(F.lit(float(default))).cast("int")
                    .alias("step_seconds"))


def drift_report(wide: DataFrame, sensors, split: str = "split", threshold_pct: float = 20.0
                 ) -> DataFrame:
    """Mean per sensor in TRAIN vs TEST and shift % = |v - t| / |t| * 100
    (skipped when t is 0 / NULL); flag above the threshold (A15)."""
    from moldwatch.plans.monitor import unpivot
    long = unpivot(wide.select(split, *sensors), sensors, keys=(split,), var="sensor")
    agg = long.groupBy("sensor").agg(
        F.avg(F.when(F.col(split) == "TRAIN", F.col("value"))).alias("train_mean"),
        F.avg(F.when(F.col(split) == "TEST", F.col("value"))).alias("test_mean"))
    t, v = F.col("train_mean"), F.col("test_mean")
    shift = F.when(t.isNotNull() & (t != 0), F.abs(v - t) / F.abs(t) * 100)
    return agg.select("sensor", "train_mean", "test_mean", shift.alias("shift_pct"),
                      F.coalesce(shift > threshold_pct, F.lit(False)).alias("shifted"))


def machine_overlap(df: DataFrame, keys=("machine_id",), split: str = "split") -> DataFrame:
    """Rows per machine in TRAIN and TEST."""
    p = df.groupBy(*keys).pivot(split, ["TRAIN", "TEST"]).count()
    return p.select(*keys, F.coalesce("TRAIN", F.lit(0)).alias("train_rows"),
                    F.coalesce("TEST", F.lit(0)).alias("test_rows"))


def with_source_file(scan: DataFrame) -> DataFrame:
    """Adds ``source_file`` (base name) from the file-scan metadata; apply
    directly on a ``spark.read`` result."""
    return scan.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
                       .alias("source_file"))


def source_coverage(df: DataFrame, n_columns: int, keys=("machine_id",), ts: str = "timestamp") -> DataFrame:
    """Per source file (and key): first / last timestamp, rows, column count
    (A17); ``df`` carries ``source_file`` (see ``with_source_file``), ``n_columns`` is
    the number of columns of the scanned files."""
    return df.groupBy("source_file", *keys).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows")) \
        .withColumn("n_columns", F.lit(n_columns))


def scrap_rate_gate(df: DataFrame, label: str = "is_scrap", keys=()) -> DataFrame:
    """Scrap label rate and its sanity verdict (A28): > 10 % HIGH, > 5 %
    ELEVATED, < 0.1 % LOW, else OK."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                F.sum(label).cast("long").alias("scrap_rows"))
    pct = F.col("scrap_rows") / F.col("rows") * 100
    verdict = (F.when(pct > 10, "HIGH").when(pct > 5, "ELEVATED").when(pct < 0.1, "LOW")
               .otherwise("OK"))
    return agg.select(*keys, "rows", "scrap_rows", pct.alias("scrap_pct"), verdict.alias("verdict"))
