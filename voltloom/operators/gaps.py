"""Gap inventory, gap rules and gap profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def inventory(samples: DataFrame, gaps: DataFrame, keys: Keys, step_min: int, dead_pct: float = 99.0) -> DataFrame:
    """Per channel: missing share, number of gaps, longest gap in minutes, dead flag."""
    share = samples.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.count_if(F.col("value").isNull()).alias("n_missing")
    )
    runs = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.max("n").alias("_longest"))
    pct = F.col("n_missing") * 100.0 / F.col("n_points")
    return share.join(runs, list(keys), "left").select(
        *keys,
        "n_points",
        "n_missing",
        pct.alias("missing_pct"),
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        (F.coalesce("_longest", F.lit(0)) * step_min).alias("longest_min"),
        (pct >= dead_pct).alias("is_dead"),
    )


def rule_bounds(longest: Column, short: int = 60, thirds: bool = False) -> list[tuple[Column, Column | None]]:
    """Bounds of the four length classes from the longest gap.

    Default: up to ``short``, to base, to twice base, beyond, with base a third of the longest gap (at
    least ``short``). ``thirds``: cuts at one and two thirds of the longest gap, strictly rising.
    """
    if thirds:
        c1 = F.greatest(F.floor(longest / 3), F.lit(1))
        c2 = F.greatest(F.floor(longest * 2 / 3), c1 + 1)
        c3 = F.greatest(longest, c2 + 1)
        return [(F.lit(1), c1), (c1 + 1, c2), (c2 + 1, c3), (c3 + 1, None)]
    base = F.greatest(F.floor(longest / 3), F.lit(short))
    return [(F.lit(1), F.lit(short)), (F.lit(short + 1), base), (base + 1, base * 2), (base * 2 + 1, None)]


def gap_rule(longest: DataFrame, thirds: bool = False, short: int = 60) -> DataFrame:
    """Four rows ``(category, min_min, max_min, portions)`` from the one row ``max_gap_min``."""
    bounds = rule_bounds(F.col("max_gap_min"), short, thirds)
    rows = [
        F.struct(
            F.lit(i + 1).alias("category"),
            lo.cast("long").alias("min_min"),
            (hi if hi is not None else F.lit(None)).cast("long").alias("max_min"),
            F.lit(i + 1).alias("portions"),
        )
        for i, (lo, hi) in enumerate(bounds)
    ]
    return longest.select(F.inline(F.array(*rows)))


def classify(gaps: DataFrame, rule: DataFrame, length_min: Column) -> DataFrame:
    """Category of each gap: range join with the four-row rule."""
    hit = gaps.withColumn("length_min", length_min)
    r = F.broadcast(rule)  # four rows by construction
    inside = (F.col("length_min") >= r.min_min) & (r.max_min.isNull() | (F.col("length_min") <= r.max_min))
    return hit.join(r, inside)
