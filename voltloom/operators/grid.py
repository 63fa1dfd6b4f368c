"""Common time grid: bucketing, means, calendars, presence and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def grid_index(time: Column, origin: str | Column, step: int) -> Column:
    """Ordinal of the grid step of ``step`` seconds that holds an instant."""
    start = F.to_timestamp(F.lit(origin)) if isinstance(origin, str) else origin
    return F.floor((F.unix_micros(time) - F.unix_micros(start)) / F.lit(step * 1_000_000)).cast("long")


def grid_time(x: Column, origin: str, step: int) -> Column:
    return F.timestamp_micros(
        F.unix_micros(F.to_timestamp(F.lit(origin))) + x * F.lit(step * 1_000_000)
    )


def grid_mean(
    rows: DataFrame,
    keys: Keys,
    variables: Sequence[str],
    origin: str,
    step: int,
    null_as_zero: bool = True,
    time: str = "time",
) -> DataFrame:
    """Mean of every quantity per grid step, in one shuffle for all columns."""
    cell = (lambda v: F.coalesce(F.col(v), F.lit(0.0))) if null_as_zero else F.col
    return (
        rows.filter(F.col(time).isNotNull())
        .withColumn("x", grid_index(F.col(time), origin, step))
        .groupBy(*keys, "x")
        .agg(*[F.avg(cell(v)).alias(v) for v in variables])
    )


def calendar(df: DataFrame, keys: Keys) -> DataFrame:
    """Every grid step of every series, from the origin (or the first reading, if that is earlier) to the last reading of all."""
    span = df.agg(F.least(F.lit(0), F.min("x")).cast("long").alias("_lo"), F.max("x").cast("long").alias("_hi"))  # one row
    return df.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("x"))


def densify(df: DataFrame, keys: Keys) -> DataFrame:
    """Left join on the full calendar; missing steps become rows of NULL."""
    return calendar(df, keys).join(df, [*keys, "x"], "left")


def to_long(df: DataFrame, ids: Keys, variables: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(variables), "variable", "value")


def latest_origin(rows: DataFrame, key: str, skip: Sequence[int] = (), time: str = "time") -> DataFrame:
    """One row: first and last start over the series, and the last reading."""
    spans = (
        rows.filter(~F.col(key).isin(list(skip)) if skip else F.lit(True))
        .groupBy(key)
        .agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    )
    return spans.agg(
        F.max("t0").alias("latest_start"),
        F.min("t0").alias("first_start"),
        F.max("t1").alias("last_time"),
        F.count("*").alias("n_series"),
    )


def coverage(dense: DataFrame, key: str, present: Column) -> DataFrame:
    """Grid steps, steps with data, gaps and their percentage."""
    return dense.groupBy(key).agg(
        F.count("*").alias("n_grid"),
        F.count_if(present).alias("n_data"),
        F.count_if(~present).alias("n_gap"),
        (F.count_if(~present) * 100.0 / F.count("*")).alias("gap_pct"),
    )
