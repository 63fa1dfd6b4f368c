"""Scalar rules of the domain as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltloom.functions.numeric import col

# fixed values: gap length in minutes -> amplitude gain
GAIN_LENGTH = (60.0, 180.0, 360.0, 720.0)
GAIN = (1.16, 1.57, 1.61, 1.84)


def huber(r: str | Column, delta: float) -> Column:
    a = F.abs(col(r))
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def rel_change_pct(before: str | Column, after: str | Column, signed: bool = False) -> Column:
    """Relative change in percent with a floor of 1e-6 on the reference."""
    diff = col(after) - col(before)
    return (diff if signed else F.abs(diff)) / F.greatest(F.abs(col(before)), F.lit(1e-6)) * 100.0


def k_of_length(length: str | Column) -> Column:
    """Gain by gap length, linear in the logarithm, flat outside the table."""
    x = F.log(F.greatest(col(length).cast("double"), F.lit(1e-9)))
    out = F.lit(GAIN[-1])
    for i in range(len(GAIN) - 2, -1, -1):
        lo, hi = math.log(GAIN_LENGTH[i]), math.log(GAIN_LENGTH[i + 1])
        out = F.when(x <= hi, GAIN[i] + (GAIN[i + 1] - GAIN[i]) * (x - lo) / (hi - lo)).otherwise(out)
    return F.when(x <= math.log(GAIN_LENGTH[0]), F.lit(GAIN[0])).otherwise(out)


def smoothstep(z: str | Column) -> Column:
    c = F.least(F.greatest(col(z), F.lit(0.0)), F.lit(1.0))
    return c * c * (3.0 - 2.0 * c)


def confidence_code(category: str | Column, low: str | Column) -> Column:
    """1 first category, 4 fourth category, in between 3 with low confidence and 2 without."""
    c = col(category)
    return F.when(c <= 1, 1).when(c >= 4, 4).when(col(low), 3).otherwise(2).cast("int")


def effect_label(d: str | Column) -> Column:
    a = F.abs(col(d))
    return (
        F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")
    )


def sig_stars(p: str | Column) -> Column:
    return F.when(col(p) < 0.001, "***").when(col(p) < 0.01, "**").when(col(p) < 0.05, "*").otherwise("ns")
