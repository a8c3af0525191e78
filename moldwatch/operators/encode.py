"""Category context and encodings."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.functions import tool_from_definition
from moldwatch.operators.limits import config_dim
from moldwatch.session import materialize


def first_non_null(df: DataFrame, keys, ts: str, column: str, out: str) -> DataFrame:
    """Per key, the value of ``column`` at its earliest non-NULL timestamp.

    The earliest timestamp is a hash partial aggregate (one row per key);
    the values at that timestamp come from a join with it (broadcast by AQE
    when small) and ties are resolved by ``min`` on that tiny result -- no
    sort-based aggregate over the raw rows."""
    keys = list(keys)
    nn = df.where(F.col(column).isNotNull()).select(*keys, ts, F.col(column).alias(out))
    first_ts = nn.groupBy(*keys).agg(F.min(ts).alias(ts))
    return nn.join(first_ts, keys + [ts]).groupBy(*keys).agg(F.min(out).alias(out))


def machine_context(df: DataFrame, keys=("machine_id",), ts: str = "timestamp",
                    definition: str = "machine_definition", variant: str = "A") -> DataFrame:
    """Per machine: first non-NULL definition in time order (E2), tool id
    parsed from it (P6/P7/P8), part number from a 'part' column if any else
    UNKNOWN; an explicit 'tool' column overrides the parsed tool."""
    keys = list(keys)
    part_cols = [c for c in df.columns if "part" in c.lower() and c not in keys]
    tool_cols = [c for c in df.columns if "tool" in c.lower() and c not in keys]
    ctx = first_non_null(df, keys, ts, definition, "machine_definition")
    if part_cols:
        ctx = ctx.join(first_non_null(df, keys, ts, part_cols[0], "_part"), keys, "full")
    if tool_cols:
        ctx = ctx.join(first_non_null(df, keys, ts, tool_cols[0], "_tool"), keys, "full")
    tool = tool_from_definition("machine_definition", variant)
    if tool_cols:
        tool = F.coalesce(F.col("_tool").cast("string"), tool)
    part = F.coalesce(F.col("_part").cast("string"), F.lit("UNKNOWN")) if part_cols \
        else F.lit("UNKNOWN")
    return ctx.select(*keys, "machine_definition", tool.alias("tool_id"), part.alias("part_number"))


def fit_label_encoding(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values -> 0..n-1 (E1).  The distinct values are dealt into ranges in
    sorted order and written once; a value's code is its rank in its range plus the number of
    values in the ranges before, so only the counts (one row a range) meet in one task."""
    d = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()) \
        .distinct()
    d = materialize(d.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return d.join(offsets, "_range").select(
        F.lit(column).alias("column"), "value", (F.col("_offset") + rank).cast("int").alias("code"))


def apply_encoding(df: DataFrame, encodings: DataFrame, column: str, out: str | None = None,
                   default: int = 0, broadcast_dim: bool = False) -> DataFrame:
    """Left join the code of ``column``; unseen / NULL -> ``default``.

    Note: the default 0 collides with the first code (kept as specified).
    """
    enc = encodings.where(F.col("column") == column).select(
        F.col("value").alias("_v"), F.col("code").alias("_code"))
    enc = config_dim(enc) if broadcast_dim else enc
    j = df.join(enc, F.col(column).cast("string") == F.col("_v"), "left")
    return j.withColumn(out or f"{column}_encoded",
                        F.coalesce(F.col("_code"), F.lit(default))).drop("_v", "_code")


def encode_with_map(df: DataFrame, column: str, mapping, out: str | None = None,
                    default: int = 0) -> DataFrame:
    """Serving-time encoding from a fixed configuration map (E3): a literal
    map lookup inside the projection -- no join; unseen / NULL -> default."""
    pairs = [x for v, code in mapping for x in (F.lit(str(v)), F.lit(int(code)))]
    m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")
    return df.withColumn(out or f"{column}_encoded",
                         F.coalesce(m[F.col(column).cast("string")], F.lit(default)))
