"""Vector columns as matrices (shared by the operators on embeddings)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Columns id and vec of the rows whose vector has no null and no non-finite component, and
    the vectors' width: the most frequent one (of equally frequent ones the larger).  Vectors
    that are null, empty or of another width are left out; without any the width is 0."""
    inf = F.lit(float("inf"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).filter(
        F.col("vec").isNotNull()).filter(F.size("vec") > 0).filter(fine)
    common = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    return rows.filter(F.size("vec") == width), width


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A batch's vectors as a row each, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
