"""Control-room table for all machines at once (D17 and its parts D10,
D13, D14, D16, A25, A26, U3, F3, P5, P7, P16-P18, M3-M6).

past window (P13) -> fill (W10) -> dynamic limits (A10) -> root causes and
risk (D6/D7) -> future horizon: recursive linear forecast (M3) or flat
carry-forward (M4), garbage clamp (M6), scored by the served model with the
idle mask (M5) -> summary counts (A25) -> downsampled past + future timeline
(F3, U3) with alert dots (D14) -> prediction summary (A26) and frozen check
(D13).  Every per-machine list is bounded (sensors, timeline points).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moldwatch.functions import clip_probability, display_machine_id, is_idle
from moldwatch.ml.models import score
from moldwatch.operators.alerts import alert_dot, status_grid
from moldwatch.operators.encode import machine_context
from moldwatch.operators.forecast import clamp_garbage, recursive_linear_forecast
from moldwatch.operators.latest import latest_row
from moldwatch.operators.order import last_n_per_key
from moldwatch.operators.sampling import append_future, downsample_stride
from moldwatch.plans.monitor import filled_window, machine_health, unpivot, window_limits
from moldwatch.session import materialize


def future_horizon(filled: DataFrame, sensors, model, forecaster=None, future_window: int = 35,
                   limits: dict | None = None, threshold: float = 0.55) -> DataFrame:
    """Future rows per machine at 1-minute steps, scored (M3-M6): ``future_window`` of them, 5 to
    60, and six at least.  Only the rows that the forecaster looks back on are read.  ``model``: a fitted
    pipeline, or a function that adds ``scrap_probability``."""
    if not 5 <= future_window <= 60:
        raise ValueError("future_window must be 5 to 60 minutes")
    steps = max(6, future_window)
    look_back = forecaster[2] + 1 if forecaster is not None else 1
    recent = last_n_per_key(filled, ("machine_id",), "timestamp", look_back).drop("_rn")
    last = latest_row(recent.select("machine_id", "timestamp", *sensors))
    if forecaster is not None:
        coef, icpt, lags = forecaster
        fc = recursive_linear_forecast(recent, sensors, coef, icpt, lags, steps, limits=limits)
    else:  # flat carry-forward of the last value
        fc = (last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
              .withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp")
                                                          + F.col("step") * 60_000_000)))
    la = last.select("machine_id", *[F.col(s).alias(f"_la_{s}") for s in sensors])
    fc = fc.join(la, "machine_id").select(
        "machine_id", "step", "timestamp",
        *[clamp_garbage(F.col(s), F.col(f"_la_{s}")).alias(s) for s in sensors])
    rows = fc.select("machine_id", "step", "timestamp", *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in sensors])
    scored = model(rows) if callable(model) else score(model, rows)
    p = F.when(is_idle("Cycle_time"), F.lit(0.0)).otherwise(clip_probability("scrap_probability"))
    return scored.select("machine_id", "step", "timestamp", *sensors, p.alias("scrap_probability"),
                         F.lit(0).alias("is_scrap_actual"),
                         (p >= threshold).cast("int").alias("predicted_scrap"))


def control_room(hist: DataFrame, raw_telemetry: DataFrame, machines: DataFrame, sensors,
                 tolerances: DataFrame, model, forecaster=None, *, time_window: int,
                 future_window: int, max_past: int, max_future: int,
                 threshold: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Returns (machines table, timeline table): the last ``time_window`` minutes and the next
    ``future_window``, the timeline downsampled to ``max_past`` and ``max_future`` points."""
    filled = materialize(filled_window(hist, sensors, time_window))  # the window, read by every part below
    health = machine_health(filled, sensors, tolerances)
    lim = window_limits(filled, sensors, tolerances)
    fut = future_horizon(filled, sensors, model, forecaster, future_window, threshold=threshold)

    # timeline (U3): downsampled past + future points, sensors restricted to
    # the machine's limit sensors, finite and |v| <= 5000, 2 dp
    past = downsample_stride(filled.select("machine_id", "timestamp", *sensors, "scrap_probability",
                                           "is_scrap_actual"), max_past)
    future = downsample_stride(fut.select("machine_id", "timestamp", *sensors, "scrap_probability",
                                          "is_scrap_actual"), max_future)
    tl = append_future(past, future)
    lim_names = lim.groupBy("machine_id").agg(F.collect_set("sensor").alias("_lim"))
    tl = tl.join(lim_names, "machine_id", "left")
    m = F.map_from_arrays(F.array(*[F.lit(s) for s in sensors]),
                          F.array(*[F.col(s).cast("double") for s in sensors]))
    m = F.map_filter(m, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 5000)
                     & F.array_contains(F.coalesce(F.col("_lim"), F.array().cast("array<string>")), k))
    m = F.transform_values(m, lambda k, v: F.bround(v, 2))
    risk_pt = F.bround(F.coalesce(F.col("scrap_probability"), F.lit(0.0)), 2)
    timeline = tl.select(
        "machine_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        risk_pt.alias("risk_score"), "is_future",
        F.coalesce(F.col("is_scrap_actual"), F.lit(0)).cast("int").alias("is_scrap_actual"),
        F.to_json(m).alias("sensors"),
        alert_dot("is_scrap_actual", "is_future", risk_pt).alias("alert_dot"))

    # The last past point takes max(risk, adjusted risk); future points
    # get + min(.2, .05 * breaches).  Windows here run over one machine's
    # timeline (at most max_past + max_future points).
    from pyspark.sql import Window
    lastp = F.max(F.when(~F.col("is_future"), F.col("timestamp"))).over(Window.partitionBy("machine_id"))
    h = health.select("machine_id", "current_risk", "n_breached")
    timeline = timeline.join(h, "machine_id", "left").withColumn(
        "adjusted_risk",
        F.when(F.col("is_future"), F.least(F.lit(1.0), F.col("risk_score") + F.least(
            F.lit(0.2), F.lit(0.05) * F.coalesce("n_breached", F.lit(0)))))
        .when(F.col("timestamp") == lastp, F.greatest("risk_score", F.coalesce("current_risk", F.lit(0.0))))
        .otherwise(F.col("risk_score"))).drop("current_risk", "n_breached")

    # summary (A25) and prediction summary
    past_stats = filled.groupBy("machine_id").agg(
        F.sum((F.coalesce("is_scrap_actual", F.lit(0)) >= 1).cast("long")).alias("past_scrap_detected"))
    fut_stats = fut.groupBy("machine_id").agg(
        F.sum((F.col("scrap_probability") >= threshold).cast("long")).alias("future_scrap_predicted"))
    pts = timeline.groupBy("machine_id").agg(
        (F.avg(F.when(~F.col("is_future"), F.col("risk_score"))) * 100).alias("avg_past_risk_pct"),
        (F.avg(F.when(F.col("is_future"), F.col("risk_score"))) * 100).alias("avg_future_risk_pct"),
        F.sum((~F.col("is_future")).cast("long")).alias("n_past_points"),
        F.sum(F.col("is_future").cast("long")).alias("n_future_points"))
    trend = F.coalesce(F.col("avg_future_risk_pct"), F.lit(0.0)) - F.coalesce(F.col("avg_past_risk_pct"), F.lit(0.0))
    trend_text = (F.when(trend > 0, F.concat(F.lit("Upward +"), F.format_number(trend, 1), F.lit("%")))
                  .when(trend < 0, F.concat(F.lit("Downward "), F.format_number(trend, 1), F.lit("%")))
                  .otherwise(F.lit("Stable 0.0%")))

    # frozen check (D13): risk > .8 and the first forecast equals the last
    # actual for every tracked sensor
    first_fc = fut.where(F.col("step") == 1).select("machine_id", *[F.col(s).alias(f"_f_{s}") for s in sensors])
    last_act = latest_row(filled.select("machine_id", "timestamp", *sensors)).select(
        "machine_id", *[F.col(s).alias(f"_a_{s}") for s in sensors])
    same = F.lit(True)
    for s in sensors:
        same = same & F.coalesce(F.col(f"_f_{s}") == F.col(f"_a_{s}"), F.lit(True))
    frozen = first_fc.join(last_act, "machine_id").select("machine_id", same.alias("_same"))

    ctx = machine_context(raw_telemetry, variant="B").select("machine_id", "tool_id", "part_number")
    t = (machines.join(health, "machine_id", "left").join(ctx, "machine_id", "left")
         .join(past_stats, "machine_id", "left").join(fut_stats, "machine_id", "left")
         .join(pts, "machine_id", "left").join(frozen, "machine_id", "left"))
    online = F.col("timestamp").isNotNull()
    risk = F.when(online, F.bround("current_risk", 2)).otherwise(F.lit(0.0))
    table = t.select(
        "machine_id", display_machine_id("machine_id").alias("display_id"),
        F.when(online, F.coalesce("tool_id", F.lit("UNKNOWN"))).otherwise(F.lit("UNKNOWN")).alias("tool_id"),
        F.lit("UNKNOWN").alias("part_number"),
        F.when(online, F.col("status")).otherwise(F.lit("OFFLINE")).alias("status"),
        risk.alias("risk_score"),
        F.when(online, F.when(F.col("root_causes") == "", F.lit("Injection_pressure"))
               .otherwise(F.col("root_causes"))).otherwise(F.lit("")).alias("root_causes"),
        F.coalesce(F.when(online, F.col("past_scrap_detected")), F.lit(0)).alias("past_scrap_detected"),
        F.coalesce(F.when(online, F.col("future_scrap_predicted")), F.lit(0)).alias("future_scrap_predicted"),
        F.coalesce("n_past_points", F.lit(0)).alias("n_past_points"),
        F.coalesce("n_future_points", F.lit(0)).alias("n_future_points"),
        F.round("avg_past_risk_pct", 6).alias("avg_past_risk_pct"),
        F.round("avg_future_risk_pct", 6).alias("avg_future_risk_pct"),
        F.when(online, trend_text).alias("trend_text"),
        F.coalesce((risk > 0.8) & F.col("_same"), F.lit(False)).alias("frozen"))
    return table, timeline


def payload(table: DataFrame, timeline: DataFrame, lim: DataFrame) -> DataFrame:
    """One nested row per machine (D17): health, its limits by sensor and its timeline in order of time, the
    past before the future.  Both collections are bounded: by the sensors and by the points that
    the timeline was cut to."""
    point = F.struct("is_future", "timestamp", "risk_score", "adjusted_risk", "is_scrap_actual", "alert_dot",
                     F.from_json("sensors", "map<string,double>").alias("sensors"))
    points = timeline.groupBy("machine_id").agg(F.collect_list(point).alias("timeline"))

    def earlier(a, b):  # maps have no order, so the points are compared by their time
        before = (~a["is_future"] & b["is_future"]) | ((a["is_future"] == b["is_future"]) & (a["timestamp"] < b["timestamp"]))
        return F.when(before, F.lit(-1)).when((a["is_future"] == b["is_future"]) & (a["timestamp"] == b["timestamp"]), F.lit(0)).otherwise(F.lit(1))

    points = points.select("machine_id", F.array_sort("timeline", earlier).alias("timeline"))
    bounds = F.struct(F.bround("min_limit", 2).alias("min"), F.bround("max_limit", 2).alias("max"))
    limits = lim.groupBy("machine_id").agg(F.map_from_entries(F.collect_list(F.struct("sensor", bounds))).alias("limits"))
    health = F.struct("status", "risk_score", "root_causes", "past_scrap_detected", "future_scrap_predicted", "trend_text", "frozen")
    x = table.join(limits, "machine_id", "left").join(points, "machine_id", "left")
    return x.select("machine_id", "display_id", "tool_id", "part_number", health.alias("health"), "limits", "timeline")


def telemetry_table(filled: DataFrame, fut: DataFrame, lim: DataFrame, sensors) -> DataFrame:
    """Latest actual and last forecast per machine and sensor with the grid
    status against the machine's limits (D16 + D11)."""
    cur = unpivot(latest_row(filled.select("machine_id", "timestamp", *sensors)), sensors,
                  var="sensor").drop("timestamp")
    last_fc = unpivot(latest_row(fut.select("machine_id", "timestamp", *sensors)), sensors,
                      var="sensor").select("machine_id", "sensor", F.col("value").alias("last_forecast"))
    g = status_grid(cur, lim.select("machine_id", "sensor", "min_limit", "max_limit", "ordinal"))
    return g.join(last_fc, ["machine_id", "sensor"], "left")

