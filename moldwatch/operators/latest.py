"""Latest-state operators (W12, W13, W14, A1-A4 pivots)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.operators.order import last_n_per_key


def latest_values(long_df: DataFrame, keys=("machine_id",), var: str = "variable_name",
                  ts: str = "timestamp", value: str = "value", tie: str | None = None
                  ) -> DataFrame:
    """Latest value per (keys, variable) (W13, batch twin of the live state).

    ``max_by(value, ts)`` keeps a fixed-width buffer, so it runs as a hash
    partial aggregate: every map task reduces its rows to one per group
    before the shuffle, and a hot machine costs one row per task.  Equal
    timestamps within a group should be averaged first (``dedup_mean``);
    ``tie`` orders them instead, at the price of a sort-based aggregate.
    """
    order = F.struct(F.col(ts), F.col(tie)) if tie and tie in long_df.columns else F.col(ts)
    return (long_df.groupBy(*keys, var)
            .agg(F.max_by(F.col(value), order).alias(value), F.max(ts).alias(ts)))


def latest_row(df: DataFrame, keys=("machine_id",), ts: str = "timestamp",
               tie: str | None = None) -> DataFrame:
    """The latest full row per key.

    The latest timestamp per key is a hash partial aggregate (one row per
    key); joining it back on (key, ts) is a broadcast hash join when AQE
    sees that the per-key table is small, so the wide side is filtered in
    place, never shuffled or sorted.  Rows sharing the latest timestamp are
    reduced by ``tie`` (largest wins) on that already tiny result.
    """
    keys = list(keys)
    mx = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    at = df.join(mx, keys + [ts])
    if tie:
        w = Window.partitionBy(*keys).orderBy(F.col(tie).desc())
        at = at.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
    return at.select(*df.columns)


def pivot_wide(long_df: DataFrame, variables, keys=("machine_id", "timestamp"),
               var: str = "variable_name", value: str = "value",
               drop_all_null: bool = False) -> DataFrame:
    """Long -> wide, duplicates at one key averaged (A1/A2).

    The pivot values are passed explicitly (no extra distinct job).  The
    grouped average is a partial aggregate; the pivot becomes conditional
    aggregates inside the same HashAggregate.
    ``drop_all_null`` drops variables without any value (costs one small
    aggregate job, so it is opt-in).
    """
    variables = list(variables)
    wide = long_df.groupBy(*keys).pivot(var, variables).agg(F.avg(value))
    if drop_all_null:
        counts = wide.agg(*[F.count(F.col(v)).alias(v) for v in variables]).first()
        keep = [v for v in variables if counts[v] > 0]
        wide = wide.select(*keys, *keep)
    return wide


def dedup_mean(long_df: DataFrame, keys=("machine_id", "variable_name", "timestamp"),
               value: str = "value") -> DataFrame:
    """One value per (machine, variable, timestamp): the mean of duplicates (A3)."""
    return long_df.groupBy(*keys).agg(F.avg(value).alias(value))


def max_label(df: DataFrame, keys=("machine_id", "timestamp"), label: str = "label") -> DataFrame:
    """Max label per key (A4)."""
    return df.groupBy(*keys).agg(F.max(label).alias(label))


def idle_by_last_rows(wide: DataFrame, column: str = "Cycle_time", n: int = 5,
                      threshold: float = 0.5, keys=("machine_id",), ts: str = "timestamp"
                      ) -> DataFrame:
    """Idle test over the last ``n`` rows of the wide history (W14): the
    column's values in those rows are all NULL, or their mean < threshold.
    Rows come from the two-level ``last_n_per_key`` (no window over a
    machine's whole history)."""
    last = last_n_per_key(wide.select(*keys, ts, column), keys, ts, n)
    return (last.groupBy(*keys)
            .agg(F.avg(column).alias("last_mean"), F.count(column).alias("n_values"))
            .withColumn("is_idle", (F.col("n_values") == 0) |
                        (F.coalesce(F.col("last_mean"), F.lit(0.0)) < threshold)))
