"""Decision operators: alert levels, root causes, risk adjustment, status
grid (D3-D16, D18).  All are column expressions or small per-machine
aggregates over long (machine, sensor) rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch import config
from moldwatch.functions import as_col
from moldwatch.operators.limits import config_dim


def alert_level(n_violations, prob, preset: str = "status", has_data=None) -> Column:
    """(level, reason) struct for a violation count and a risk probability.

    status (D3): violations -> HIGH/SAFETY VIOLATION; >= .55 HIGH/AI RISK
      PREDICTION; >= .32 MEDIUM/AI WARNING; else LOW/OPTIMAL; no data ->
      LOW/NO DATA.
    decision (D4): violations -> CRITICAL/SAFE_LIMIT_VIOLATION; >= .7 HIGH;
      >= .4 MEDIUM (ML_RISK); else LOW/NORMAL.
    live (D5): < .3 LOW, < .6 MEDIUM, else HIGH (no violation rule).
    """
    n, p = as_col(n_violations), as_col(prob)

    def lvl(level, reason):
        return F.struct(F.lit(level).alias("alert_level"), F.lit(reason).alias("decision_reason"))

    if preset == "status":
        t_hi, t_mid = config.ML_THRESHOLDS["MEDIUM"], config.ML_THRESHOLDS["LOW"]
        e = (F.when(n > 0, lvl("HIGH", "SAFETY VIOLATION"))
             .when(p >= t_hi, lvl("HIGH", "AI RISK PREDICTION"))
             .when(p >= t_mid, lvl("MEDIUM", "AI WARNING"))
             .otherwise(lvl("LOW", "OPTIMAL")))
        if has_data is not None:
            e = F.when(~as_col(has_data), lvl("LOW", "NO DATA")).otherwise(e)
        return e
    if preset == "decision":
        high, medium = (t for t, _ in config.ALERT_PRESETS["decision"])
        return (F.when(n > 0, lvl("CRITICAL", "SAFE_LIMIT_VIOLATION"))
                .when(p >= high, lvl("HIGH", "ML_RISK"))
                .when(p >= medium, lvl("MEDIUM", "ML_RISK"))
                .otherwise(lvl("LOW", "NORMAL")))
    if preset == "live":
        high, medium = (t for t, _ in config.ALERT_PRESETS["live"])
        return (F.when(p < medium, lvl("LOW", "LOW")).when(p < high, lvl("MEDIUM", "MEDIUM"))
                .otherwise(lvl("HIGH", "HIGH")))
    raise ValueError(preset)


def _span(lo, hi, kind: str) -> Column:
    if kind == "root":   # D6: max(|u-l|, |u|, |l|, 1) over the bounds present
        return F.greatest(F.coalesce(F.abs(hi - lo), F.lit(0.0)), F.coalesce(F.abs(hi), F.lit(0.0)),
                          F.coalesce(F.abs(lo), F.lit(0.0)), F.lit(1.0))
    # max(max - min, |max|, 1)
    return F.greatest(F.coalesce(hi - lo, F.lit(0.0)), F.coalesce(F.abs(hi), F.lit(0.0)),
                      F.lit(1.0))


def sensor_severity(current: DataFrame, limits: DataFrame, keys=("machine_id",),
                    min_breach: float = 0.01) -> DataFrame:
    """Per (keys, sensor): breached flag and severity (D6 inputs).

    ``current``: keys, sensor, value.  ``limits``: keys?, sensor, min_limit,
    max_limit, ordinal.  Breach = distance beyond a bound / span, kept only if
    >= ``min_breach`` (a smaller breach drops the sensor from both lists);
    otherwise severity = 1 - min(margin / span, 1).
    """
    lim_keys = [k for k in keys if k in limits.columns]
    j = current.where(F.col("value").isNotNull()).join(limits, lim_keys + ["sensor"])
    lo, hi, v = F.col("min_limit"), F.col("max_limit"), F.col("value")
    span = _span(lo, hi, "root")
    over = hi.isNotNull() & (v > hi)
    under = ~F.coalesce(over, F.lit(False)) & lo.isNotNull() & (v < lo)
    breach = F.when(over, (v - hi) / span).when(under, (lo - v) / span)
    margin = F.least(F.abs(v - lo), F.abs(hi - v))  # least skips NULL bounds
    near = 1.0 - F.least(margin / span, F.lit(1.0))
    return (j.select(*keys, "sensor", "ordinal", "value", breach.alias("_breach"), near.alias("_near"))
            .where(F.col("_breach").isNull() | (F.col("_breach") >= min_breach))
            .select(*keys, "sensor", "ordinal", "value",
                    F.col("_breach").isNotNull().alias("breached"),
                    F.coalesce("_breach", "_near").alias("severity"))
            .where(F.col("severity").isNotNull()))


def root_causes(current: DataFrame, limits: DataFrame, keys=("machine_id",), top: int = 3
                ) -> DataFrame:
    """Root causes per machine (D6): if any breach, the top ``top`` breached
    sensors by severity and the full breached list; else the top ``top`` by
    nearness.  Ties keep the limit order.  Lists are bounded by the number of
    configured limits, so ``collect_list`` per machine is small.
    """
    sev = sensor_severity(current, limits, keys)
    any_breach = F.max(F.col("breached").cast("int")).over(Window.partitionBy(*keys))
    ranked = (sev.withColumn("_any", any_breach)
              .where((F.col("_any") == 0) | F.col("breached")))
    ent = F.struct(-F.col("severity"), F.col("ordinal"), F.col("sensor"))
    agg = ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(ent)).alias("_s"), F.max("_any").alias("_any"))
    names = F.transform(F.col("_s"), lambda e: e["sensor"])
    return agg.select(
        *keys,
        F.array_join(F.slice(names, 1, top), ",").alias("root_causes"),
        F.when(F.col("_any") == 1, F.array_join(names, ",")).otherwise(F.lit(""))
        .alias("breached_sensors"),
        F.when(F.col("_any") == 1, F.size(names)).otherwise(F.lit(0)).alias("n_breached"))


def adjusted_risk(base, n_breached, step: float = 0.06, cap: float = 0.25) -> Column:
    """min(1, base + min(cap, step * breaches)) (D7; D9 preset step .12 cap .35)."""
    return F.least(F.lit(1.0), F.coalesce(as_col(base), F.lit(0.0))
                   + F.least(F.lit(cap), F.lit(step) * as_col(n_breached)))


def risk_status(risk, n_breached, high: float = None, medium: float = None) -> Column:
    """HIGH on any breach or risk >= high; MEDIUM >= medium; else LOW."""
    high = config.ML_THRESHOLDS["MEDIUM"] if high is None else high
    medium = config.ML_THRESHOLDS["LOW"] if medium is None else medium
    r = as_col(risk)
    return (F.when((as_col(n_breached) > 0) | (r >= high), "HIGH")
            .when(r >= medium, "MEDIUM").otherwise("LOW"))


def status_grid(current: DataFrame, limits: DataFrame, keys=("machine_id",),
                warn_fraction: float = 0.10) -> DataFrame:
    """Telemetry status grid (D11): critical outside limits, warning within
    ``warn_fraction`` of the span from a limit, else good.  Span = max - min,
    else max, else min, else 100.  Severity rank 0/1/2 for sorting."""
    lim_keys = [k for k in keys if k in limits.columns]
    j = current.join(limits, lim_keys + ["sensor"])
    lo, hi, v = F.col("min_limit"), F.col("max_limit"), F.col("value")
    span = F.coalesce(hi - lo, hi, lo, F.lit(100.0))
    crit = (hi.isNotNull() & (v > hi)) | (lo.isNotNull() & (v < lo))
    warn = ((hi.isNotNull() & (v >= hi - span * warn_fraction)) |
            (lo.isNotNull() & (v <= lo + span * warn_fraction)))
    status = F.when(v.isNull(), "unknown").when(crit, "critical").when(warn, "warning") \
        .otherwise("good")
    rank = F.when(status == "critical", 0).when(status == "warning", 1).otherwise(2)
    return j.select(*keys, "sensor", "ordinal", "value", "min_limit", "max_limit",
                    status.alias("status"), rank.alias("severity_rank"))


def first_abnormal(grid: DataFrame, keys=("machine_id",)) -> DataFrame:
    """First abnormal sensor per machine: critical before warning, then limit
    order (D12)."""
    ab = grid.where(F.col("severity_rank") < 2)
    return ab.groupBy(*keys).agg(
        F.min_by("sensor", F.struct("severity_rank", "ordinal")).alias("first_abnormal"))


def breach_severity_ui(current: DataFrame, limits: DataFrame, keys=("machine_id",)) -> DataFrame:
    """UI breach list (D8): span = max(max - min, |max|, 1); breach distance
    / span, sorted by severity desc (rank column)."""
    lim_keys = [k for k in keys if k in limits.columns]
    j = current.join(limits, lim_keys + ["sensor"])
    lo, hi, v = F.col("min_limit"), F.col("max_limit"), F.col("value")
    span = _span(lo, hi, "ui")
    sev = F.when(hi.isNotNull() & (v > hi), (v - hi) / span) \
        .when(lo.isNotNull() & (v < lo), (lo - v) / span)
    x = j.select(*keys, "sensor", "ordinal", "value", sev.alias("severity")) \
        .where(F.col("severity").isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col("severity").desc(), "ordinal")
    return x.withColumn("severity_rank", F.row_number().over(w))


def alert_dot(is_scrap_actual, is_future, risk, threshold: float = 0.6) -> Column:
    """Timeline marker: actual scrap, or a future point with risk > threshold."""
    return (F.coalesce(as_col(is_scrap_actual), F.lit(0)) >= 1) | \
        (F.coalesce(as_col(is_future), F.lit(False)) & (as_col(risk) > threshold))


def rca_table(violations_df: DataFrame, labels: DataFrame) -> DataFrame:
    """RCA table (D18): friendly label, 'current unit', limit, 'deviation direction'."""
    j = violations_df.join(config_dim(labels), violations_df["parameter"] == labels["sensor"], "left")
    return j.select(
        *[c for c in violations_df.columns if c in ("machine_id",)],
        F.coalesce(F.col("label"), F.regexp_replace("parameter", "_", " ")).alias("parameter_label"),
        F.concat_ws(" ", F.col("current").cast("string"), F.col("unit")).alias("current_value"),
        F.col("limit"),
        F.concat_ws(" ", F.col("deviation").cast("string"), F.col("direction")).alias("deviation"))
