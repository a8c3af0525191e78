"""Limits: percentile and dynamic limits, limit joins, violations
(A9, A10, J8, J9, D1, D2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.operators.stats import global_quantile, grouped_quantiles


def config_dim(df: DataFrame) -> DataFrame:
    """Broadcast hint for configuration dimensions.

    Only for tables built from configuration (limits, tolerances, labels,
    encodings, machine lists): their row count is fixed by the configuration
    and does not grow with the data, which is the size bound a broadcast
    needs.  Data-derived sides are left to AQE's runtime size check.
    """
    return F.broadcast(df)


def join_limits(long_df: DataFrame, limits: DataFrame, var: str = "variable_name") -> DataFrame:
    """Readings x limits on the sensor name (J8): long readings, broadcast
    inner join with the configuration dimension."""
    return long_df.join(config_dim(limits), F.col(var) == F.col("sensor")).drop("sensor")


def violations(latest: DataFrame, limits: DataFrame, keys=("machine_id",),
               style: str = "status") -> DataFrame:
    """Limit violations of the current values (D1; D2 with ``style='rules'``).

    ``latest``: keys, variable_name, value.  Strict ``>`` max / ``<`` min.
    status: current 2 dp, deviation 2 dp, direction above/below.
    rules:  safe_limit text '≤ x' / '≥ x', deviation 3 dp,
            direction ABOVE_LIMIT / BELOW_LIMIT; NULL values skipped.
    Rounding is half-even like Python's ``round``.
    """
    j = join_limits(latest.where(F.col("value").isNotNull()), limits)
    above = F.col("max_limit").isNotNull() & (F.col("value") > F.col("max_limit"))
    below = F.col("min_limit").isNotNull() & (F.col("value") < F.col("min_limit"))
    sides = F.array(
        F.when(above, F.struct(F.lit("above").alias("side"), F.col("max_limit").alias("lim"),
                               (F.col("value") - F.col("max_limit")).alias("dev"))),
        F.when(below, F.struct(F.lit("below").alias("side"), F.col("min_limit").alias("lim"),
                               (F.col("min_limit") - F.col("value")).alias("dev"))))
    x = (j.where(above | below)
         .select(*keys, "variable_name", "value", "unit", "ordinal",
                 F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("v")))
    if style == "status":
        return x.select(*keys, F.col("variable_name").alias("parameter"),
                        F.bround("value", 2).alias("current"),
                        F.col("v.lim").alias("limit"), F.col("unit"),
                        F.bround("v.dev", 2).alias("deviation"),
                        F.col("v.side").alias("direction"), "ordinal")
    if style == "rules":
        txt = F.when(F.col("v.side") == "above", F.lit("≤ ")).otherwise(F.lit("≥ "))
        return x.select(*keys, F.col("variable_name").alias("parameter"),
                        F.col("value").alias("current"),
                        F.concat(txt, F.col("v.lim").cast("string")).alias("safe_limit"),
                        F.bround("v.dev", 3).alias("deviation"),
                        F.when(F.col("v.side") == "above", "ABOVE_LIMIT")
                        .otherwise("BELOW_LIMIT").alias("direction"), "ordinal")
    raise ValueError(style)


def merge_limits(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override fields win over base limits (J9); sensors only in the override
    are added."""
    o = override.select(F.col("sensor"), F.col("min_limit").alias("_omin"),
                        F.col("max_limit").alias("_omax"), F.col("unit").alias("_ounit"))
    return (base.join(o, "sensor", "full")
            .select("sensor",
                    F.coalesce("_omin", "min_limit").alias("min_limit"),
                    F.coalesce("_omax", "max_limit").alias("max_limit"),
                    F.coalesce("_ounit", "unit").alias("unit"),
                    F.coalesce("ordinal", F.lit(10_000)).alias("ordinal")))


def percentile_limits(long_df: DataFrame, prob_col: str = "scrap_probability",
                      max_prob: float = 0.30, lo: float = 0.01, hi: float = 0.99,
                      var: str = "variable_name", value: str = "value") -> DataFrame:
    """Safe limits from low-risk rows: 1st / 99th percentile per sensor, 2 dp.

    Exact, by ``global_quantile``, so a hot sensor is never one task.
    """
    rows = long_df.where(F.col(prob_col) < max_prob)
    agg = global_quantile(rows, value, [lo, hi], keys=[var], out=["_qlo", "_qhi"]) \
        .select(var, F.array("_qlo", "_qhi").alias("_q"))
    return agg.select(F.col(var).alias("sensor"),
                      F.bround(F.col("_q")[0], 2).alias("min_limit"),
                      F.bround(F.col("_q")[1], 2).alias("max_limit"))


def dynamic_limits(window_long: DataFrame, tolerances: DataFrame, keys=("machine_id",),
                   var: str = "variable_name", value: str = "value",
                   floor_fraction: float = 0.05, excluded=None) -> DataFrame:
    """Dynamic limits over a recent window (A10).

    Per (keys, sensor): median and sample std of the window; both
    tolerances present -> ``median - |tol-| .. median + |tol+|``; else
    ``median +- max(3 sigma, floor_fraction * |median|)`` (sigma NULL -> 0).
    The lower limit is clamped at 0 unless the name contains deviation /
    offset / tmp.  Only sensors present in the tolerance rules, minus the
    non-sensor columns.  Median: exact, over values counted per (keys, sensor,
    value) first, so a group's buffer holds its distinct values.
    """
    excluded = config.NON_SENSOR_COLUMNS if excluded is None else excluded
    rules = tolerances.where(~F.col("variable_name").isin(list(excluded)))
    w = window_long.where(F.col(value).isNotNull())
    stats = w.groupBy(*keys, var).agg(F.stddev_samp(value).alias("std"))
    middle = grouped_quantiles(w, [*keys, var], value, [0.5]).select(*keys, var, F.col("q")[0].alias("median"))
    stats = stats.join(middle, [*keys, var])
    j = stats.join(config_dim(rules), var)
    both = F.col("tolerance_plus").isNotNull() & F.col("tolerance_minus").isNotNull()
    sigma = F.coalesce(F.col("std"), F.lit(0.0))
    margin = F.greatest(sigma * 3, F.abs("median") * floor_fraction)
    lo = F.when(both, F.col("median") - F.abs("tolerance_minus")).otherwise(F.col("median") - margin)
    hi = F.when(both, F.col("median") + F.abs("tolerance_plus")).otherwise(F.col("median") + margin)
    signed = F.lit(False)
    for kw in config.SIGNED_KEYWORDS:
        signed = signed | F.lower(F.col(var)).contains(kw)
    lo = F.when(signed, lo).otherwise(F.greatest(F.lit(0.0), lo))
    return j.select(*keys, F.col(var).alias("sensor"), "median",
                    sigma.alias("std"), lo.alias("min_limit"), hi.alias("max_limit"),
                    F.when(both, "tolerance").otherwise("sigma").alias("rule"))
