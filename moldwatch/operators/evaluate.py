"""Classification metrics.

Global order statistics (ROC-AUC, PR curve, running maxima) are computed on
per-score counts, never on raw rows: rows collapse to one row per distinct
score by a partial aggregate, and running sums over the score table use
totals per score bucket + windows inside a bucket, so no single task sorts the
whole table.  The totals travel with the rows; nothing runs while a plan is built.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.operators.stats import PER_UNIT, mono_bucket


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score: positives and negatives."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def running(df: DataFrame, order: str, aggs: dict, descending: bool = False,
            inclusive: bool = True) -> DataFrame:
    """Running aggregates over a global order in two levels.

    ``aggs``: out_name -> (fn, column) with fn in {"sum", "max"}; each also gets its
    value over all rows as ``{out_name}_all``.  Rows get the monotone bucket of
    the order value (equal values share one; scores in [0, 1] have about 45,000).
    Per-bucket totals form a small table whose running carry-in is one window over
    buckets; inside a bucket a running window finishes the job.
    """
    sign = -1 if descending else 1
    x = df.withColumn("_b", mono_bucket(F.col(order).cast("double"), PER_UNIT) * F.lit(sign))
    fns = {"sum": F.sum, "max": F.max}
    tot = x.groupBy("_b").agg(*[fns[fn](c).alias(f"_t_{k}") for k, (fn, c) in aggs.items()])
    pw = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = tot.select("_b", *[fns[fn](f"_t_{k}").over(pw).alias(f"_c_{k}") for k, (fn, _) in aggs.items()],
                       *[fns[fn](f"_t_{k}").over(every).alias(f"{k}_all") for k, (fn, _) in aggs.items()])
    hi = 0 if inclusive else -1
    o = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy("_b").orderBy(o).rowsBetween(Window.unboundedPreceding, hi)
    y = x.join(carry, "_b")
    cols = []
    for k, (fn, c) in aggs.items():
        inner = fns[fn](c).over(w)
        if fn == "sum":
            cols.append((F.coalesce(inner, F.lit(0)) + F.coalesce(F.col(f"_c_{k}"), F.lit(0))).alias(k))
        else:
            cols.append(F.greatest(inner, F.col(f"_c_{k}")).alias(k))
    return y.select(*[c for c in df.columns], *cols, *[f"{k}_all" for k in aggs])


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC-AUC (ties count one half), one row; 0 when a class is absent."""
    sc = score_counts(df, score, label)
    r = running(sc, "score", {"neg_below": ("sum", "neg")}, inclusive=False)
    agg = r.agg(F.sum(F.col("pos") * F.col("neg_below") + 0.5 * F.col("pos") * F.col("neg")).alias("_u"),
                F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(0.0))
    return agg.select(auc.alias("auc"), F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision-recall points per threshold (rows with score >= t), from the
    highest threshold reaching full recall up to the maximum score, like the
    usual precision_recall_curve; adds f1."""
    sc = score_counts(df, score, label)
    x = running(sc, "score", {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, descending=True)
    # Down to the row that completes the recall; without positives the first row alone.
    total = F.col("tp_all")
    x = x.where(F.when(total > 0, F.col("tp") - F.col("pos") < total)
                .otherwise(F.col("fp") - F.col("neg") + F.col("tp") - F.col("pos") == 0))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(total > 0, F.col("tp") / total).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return x.select(F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), "tp", "fp")


def best_threshold(pr: DataFrame, stop_precision: float = 0.85, factors=(0.4, 0.7, 1.0)
                   ) -> DataFrame:
    """Best-F1 threshold scanning thresholds upwards and stopping after the
    first one with precision >= ``stop_precision`` (that one included);
    first maximum wins.  Recommended LOW / MEDIUM / HIGH = factors x best."""
    stop = pr.where(F.col("precision") >= stop_precision).agg(F.min("threshold")).scalar()
    x = pr.where(stop.isNull() | (F.col("threshold") <= stop))
    # first maximum in ascending threshold order; no F1 above 0 -> 0.5
    top = x.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("m"))
    best_f1 = F.coalesce(F.col("m.f1"), F.lit(0.0))
    best = top.select(best_f1.alias("best_f1"), F.when(best_f1 > 0, -F.col("m.low")).otherwise(F.lit(0.5)).alias("best_threshold"))
    lo, mid, hi = factors
    return best.select(
        "best_f1", "best_threshold",
        F.bround(F.col("best_threshold") * lo, 2).alias("low_threshold"),
        F.bround(F.col("best_threshold") * mid, 2).alias("medium_threshold"),
        F.bround(F.col("best_threshold") * hi, 2).alias("high_threshold"))


def precision_buckets(pr: DataFrame, stop_precision: float = 0.85) -> DataFrame:
    """Rows where the 5 %-precision bucket int(p*20)*5 (>= 10) first exceeds
    every earlier printed bucket, up to the stop threshold (A21)."""
    stop = pr.where(F.col("precision") >= stop_precision).agg(F.min("threshold")).scalar()
    x = pr.where(stop.isNull() | (F.col("threshold") <= stop))
    b = (F.floor(F.col("precision") * 20) * 5).cast("int")
    x = x.withColumn("bucket", b).withColumn("_b10", F.when(b >= 10, b).otherwise(F.lit(0)))
    r = running(x, "threshold", {"_prev_max": ("max", "_b10")}, inclusive=False)
    return r.where((F.col("bucket") >= 10) & (F.col("bucket") > F.coalesce("_prev_max", F.lit(0)))) \
        .select("threshold", "precision", "recall", "f1", "bucket")


def confusion(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5,
              op: str = ">=") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 at a threshold."""
    pred = (F.col(score) >= threshold) if op == ">=" else (F.col(score) > threshold)
    y = F.col(label) == 1
    agg = df.agg(F.sum((pred & y).cast("long")).alias("tp"), F.sum((pred & ~y).cast("long")).alias("fp"),
                 F.sum((~pred & ~y).cast("long")).alias("tn"), F.sum((~pred & y).cast("long")).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return agg.select(F.lit(threshold).alias("threshold"), "tp", "fp", "tn", "fn",
                      ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), prec.alias("precision"),
                      rec.alias("recall"), f1.alias("f1"))


def label_balance(df: DataFrame, label: str = "label", missing_pos_default: int = 1) -> DataFrame:
    """Counts, positive %, imbalance ratio n0 / max(n1, 1)."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
                 F.sum((F.col(label) == 0).cast("long")).alias("n_neg"))
    n1 = F.coalesce(F.col("n_pos"), F.lit(0))
    denom = F.greatest(F.when(n1 == 0, F.lit(missing_pos_default)).otherwise(n1), F.lit(1))
    return agg.select("n", n1.alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
                      (n1 / F.col("n") * 100).alias("pos_pct"),
                      (F.coalesce("n_neg", F.lit(0)) / denom).alias("imbalance_ratio"))


def class_weight(df: DataFrame, label: str = "label", cap: float | None = None) -> DataFrame:
    """min(n_neg / max(n_pos, 1), cap)."""
    agg = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("n_pos"),
                 F.sum((F.col(label) != 1).cast("long")).alias("n_neg"))
    w = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    if cap is not None:
        w = F.least(w, F.lit(float(cap)))
    return agg.select("n_pos", "n_neg", w.alias("class_weight"))


def estimated_precision(df: DataFrame, keys=("machine_id",), actual: str = "is_scrap_actual",
                        predicted: str = "predicted_scrap") -> DataFrame:
    """Per key: actual and predicted counts, the naive min(a, p) / p estimate
    and the true precision (A22)."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(actual).cast("long").alias("actual"),
        F.sum(predicted).cast("long").alias("predicted"),
        F.sum(((F.col(actual) == 1) & (F.col(predicted) == 1)).cast("long")).alias("true_pos"))
    p = F.col("predicted")
    return agg.select(*keys, "rows", "actual", "predicted",
                      F.when(p > 0, F.least("actual", "predicted") / p).alias("est_precision_naive"),
                      F.when(p > 0, F.col("true_pos") / p).alias("precision"))
