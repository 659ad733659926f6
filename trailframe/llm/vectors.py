"""Vector columns: which rows take part, and their matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero and holds finite numbers only."""
    return rows.filter(
        F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
        & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vec_col, lambda x: x != 0))


def matrix(col) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a double matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)
