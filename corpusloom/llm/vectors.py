"""What the vector operators share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    v = F.col(column)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~wrong & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    values = np.asarray(lists.flatten(), dtype=np.float64)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)
