"""Exact order statistics at scale (A9, A11 helpers).

``percentile`` keeps every value of a group in one aggregation buffer.  For
a grouped quantile the values are first counted per (group, value) -- a
partial aggregate -- and the weighted percentile only sees distinct values.
For a global quantile over a column with mostly distinct values the rows
are counted per bucket of a fixed monotone rule, the buckets holding the two ranks
around p * (n - 1) are located on that small table, their rows are counted
again in equal parts of the bucket's range, and only the rows of the parts that
hold the ranks are sorted.  Nothing runs while the plan is built.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_quantiles(df: DataFrame, keys, value: str, probs, out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles per group, as array ``out``."""
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"))
    arr = ", ".join(str(float(p)) for p in probs)
    return hist.groupBy(*keys).agg(F.expr(f"percentile({value}, array({arr}), _n)").alias(out))


def mono_bucket(v, per_unit: int = 1024):
    """Deterministic, monotone (non-decreasing) bucket of a double:
    floor(sign(v) * log1p(|v|) * per_unit).  Equal values share a bucket and
    the bucket domain is bounded (about 1.5 M for all finite doubles)."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(per_unit)).cast("long")


PER_UNIT = 65_536
PARTS = 4096


def _holding(v: DataFrame, keys, bucket: str, ranks: DataFrame, known=()) -> DataFrame:
    """For each (keys, known, _r) of ``ranks``, whose _off rows of the key lie before ``v``'s
    smallest bucket: the bucket that holds rank _r, with its _off, _mn and _mx."""
    by = [*keys, *known]
    counts = v.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if not by:
        by, offs, ranks = ["_k"], offs.withColumn("_k", F.lit(0)), ranks.withColumn("_k", F.lit(0))
    j = offs.join(ranks, by)  # a table of buckets and one of ranks: both small
    start = F.col("_off") + F.col("_before")
    return (j.where((start <= F.col("_r")) & (F.col("_r") < start + F.col("_c")))
            .select(*keys, *known, bucket, "_r", "_mn", "_mx", start.alias("_off")))


def global_quantile(df: DataFrame, value: str, p, keys=(), out="q") -> DataFrame:
    """Exact quantile(s) (linear interpolation, like numpy/pandas) of
    ``value`` per ``keys`` (may be empty); ``p`` a float (column ``out``) or
    a list (columns ``out[i]``).

    Rows are counted per (keys, monotone bucket), then those of the buckets
    holding ranks floor / ceil of p * (n - 1) per equal part of the bucket's
    range; a constant bucket or part answers directly, only rows of mixed parts are
    ranked.  No task sorts a whole column or a whole hot key.
    """
    probs = [p] if isinstance(p, (int, float)) else list(p)
    outs = [out] if isinstance(p, (int, float)) else list(out)
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    v = v.withColumn("_b", mono_bucket(F.col("_v"), PER_UNIT))
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = []
    for q in probs:
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        wanted += [F.floor(pos), F.ceil(pos)]
    ranks = n.where("_n > 0").select(*keys, F.explode(F.array_distinct(F.array(*wanted))).alias("_r"), F.lit(0).alias("_off"))
    coarse = _holding(v, keys, "_b", ranks)
    mixed = coarse.where(F.col("_mn") < F.col("_mx"))
    inside = mixed.select(*keys, "_b", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi")).distinct()
    rows = v.join(inside, [*keys, "_b"])
    rows = rows.withColumn("_s", F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (PARTS - 1)).cast("long"))
    fine = _holding(rows, keys, "_s", mixed.select(*keys, "_b", "_r", "_off"), known=["_b"])
    part = rows.join(fine.where(F.col("_mn") < F.col("_mx")).select(*keys, "_b", "_s").distinct(), [*keys, "_b", "_s"])
    nth = F.row_number().over(Window.partitionBy(*keys, "_b", "_s").orderBy("_v")) - 1
    picked = part.withColumn("_i", nth).join(fine, [*keys, "_b", "_s"]).where(F.col("_off") + F.col("_i") == F.col("_r"))
    constant = [t.where(F.col("_mn") == F.col("_mx")).select(*keys, "_r", F.col("_mn").alias("_val")) for t in (coarse, fine)]
    vals = picked.select(*keys, "_r", F.col("_v").alias("_val"))
    for c in constant:
        vals = vals.unionByName(c)
    j = n.join(vals, keys, "left") if keys else vals.withColumn("_n", n.select("_n").scalar())
    aggs = []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        aggs += [F.max(F.when(F.col("_r") == F.floor(pos), F.col("_val"))).alias(f"_lo{i}"),
                 F.max(F.when(F.col("_r") == F.ceil(pos), F.col("_val"))).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr{i}")]
    agg = j.groupBy(*keys).agg(*aggs)
    return agg.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}"))
                               .alias(o) for i, o in enumerate(outs)])
