"""Schema helpers: pick columns from a schema before a plan is built
(P12, P21, P23, U4, U5).  They read ``df.columns`` / ``df.dtypes`` only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.startswith(_NUMERIC)]


def leakage_excluded(df: DataFrame, prefixes, mode: str = "exact_or_block") -> list[str]:
    """Numeric columns without leaking counters."""
    from moldwatch.ml.models import leakage_free
    return leakage_free(numeric_columns(df), prefixes, mode)


def resolve_column(df: DataFrame, name: str) -> str | None:
    """Exact name, else the first ``name__*`` column."""
    if name in df.columns:
        return name
    for c in df.columns:
        if c.startswith(name + "__"):
            return c
    return None


def first_label(df: DataFrame, candidates=("is_scrap", "early_scrap_risk", "is_scrap_actual")) -> str | None:
    """First available label column among candidates."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def missing_columns(spark: SparkSession, have: DataFrame, expected) -> DataFrame:
    """Expected names absent from ``have`` (U5) as a one-column DataFrame:
    EXCEPT over two schema DataFrames."""
    a = spark.createDataFrame([(c,) for c in expected], "column string")
    b = spark.createDataFrame([(c,) for c in have.columns], "column string")
    return a.exceptAll(b)
