"""Median of pairwise slopes of short arrays (vectorised)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def theil_sen(arrays: pd.Series) -> pd.Series:
    """Median slope over all pairs of known values of an array, 0 below two values."""

    def slope(a) -> float:
        y = np.array([np.nan if v is None else v for v in a] if a is not None else [], dtype=float)
        y = y[np.isfinite(y)]
        if y.size < 2:
            return 0.0
        i, j = np.triu_indices(y.size, 1)
        return float(np.median((y[j] - y[i]) / (j - i)))

    return arrays.map(slope)
