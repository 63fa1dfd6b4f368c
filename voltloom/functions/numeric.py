"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: str | Column) -> Column:
    """NaN counts as a value in Spark; the library only knows NULL."""
    return F.when(F.isnan(col(c)), F.lit(None)).otherwise(col(c))


def fixed(c: str | Column, digits: int = 4) -> Column:
    """Round half up with a fixed nudge, so that decimal ties resolve alike in every engine."""
    scale = float(10**digits)
    return F.floor(col(c).cast("double") * F.lit(scale) + F.lit(0.50031)) / F.lit(scale)


def fixed_sql(expr: str, digits: int = 4) -> str:
    """The same rounding as ANSI SQL text."""
    scale = f"{10**digits}.0"
    return f"(floor(({expr}) * {scale}::double + 0.50031::double) / {scale}::double)"


def ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return col(num) / F.nullif(col(den).cast("double"), F.lit(0.0))


def share(cond: Column, valid: Column) -> Column:
    """Aggregate: share of the valid rows that meet a condition, NULL without valid rows."""
    return ratio(F.count_if(cond & valid), F.count_if(valid))


def value_bin(v: str | Column, per_octave: int = 1024) -> Column:
    """Order-preserving coarse code of a double: octave and position inside it.

    Depends on the value alone, so a recomputed task yields the same code. Values of one code lie
    within ``1/per_octave`` of each other.
    """
    a = F.abs(col(v))
    octave = F.floor(F.log2(a))
    inside = F.floor((a / F.pow(F.lit(2.0), octave) - 1.0) * per_octave)
    code = (octave + F.lit(1100)) * per_octave + inside
    return F.when(a == 0, F.lit(0)).otherwise((F.signum(col(v)) * code).cast("long")).cast("long")


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Aggregate: Pearson correlation over rows that hold both values, NULL without variance."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
