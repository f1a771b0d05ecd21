"""What the two vector operators share: which vectors take part, and their form in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 4096  # vectors that axes or a centre are fitted on; results don't depend on them


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def element(df: DataFrame, vector: str = "embedding") -> str:
    """The numpy type that holds the components without loss."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def matrix(lists) -> np.ndarray:
    """Rows of one Arrow list column whose lists all have the same length, in double precision."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for very large or small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fitted_sample(df: DataFrame, key: str, vector: str = "embedding", size: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``size`` rows, chosen by a hash of ``key``; for the commonest dimension."""
    rows = df.orderBy(F.xxhash64(key), key).limit(size).select(vector).collect()
    found = [r[0] for r in rows]
    sizes = [len(v) for v in found]
    if not found:
        return np.zeros((0, 0))
    common = max(set(sizes), key=lambda d: (sizes.count(d), d))
    return units(np.array([v for v in found if len(v) == common], dtype=np.float64))
