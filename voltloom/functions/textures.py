"""Shape of short arrays (vectorised helpers)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = T.StructType([T.StructField("sd", T.DoubleType()), T.StructField("freq", T.DoubleType()), T.StructField("mad", T.DoubleType()), T.StructField("n", T.IntegerType())])


def _from_chord(a) -> np.ndarray:
    y = np.asarray(a if a is not None else [], dtype=float)
    if y.size < 2:
        return np.zeros(y.size)
    return y - np.linspace(y[0], y[-1], y.size)


def _shape(d: np.ndarray) -> tuple:
    if d.size == 0:
        return (0.0, 0.0, 0.0, 0)
    turns = np.count_nonzero(np.diff(np.sign(np.diff(d)))) / (d.size - 2) if d.size > 2 else 0.0
    return (float(d.std()), float(turns), float(1.4826 * np.median(np.abs(d - np.median(d)))), int(d.size))


@F.pandas_udf(SHAPE)
def chord_shape(arrays: pd.Series) -> pd.DataFrame:
    """Deviation, turning share and scaled MAD of an array around its chord."""
    return pd.DataFrame([_shape(_from_chord(a)) for a in arrays], columns=["sd", "freq", "mad", "n"])


@F.pandas_udf(SHAPE)
def two_sided_shape(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The same over the chord deviations of both sides of a gap, one after the other."""
    rows = []
    for b, a in zip(before, after):
        parts = [_from_chord(s) for s in (b, a) if s is not None and len(s) >= 2]
        rows.append(_shape(np.concatenate(parts) if parts else np.zeros(0)))
    return pd.DataFrame(rows, columns=["sd", "freq", "mad", "n"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_chord(arrays: pd.Series) -> pd.Series:
    return arrays.map(_from_chord)
