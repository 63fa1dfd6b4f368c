"""Exact order statistics of groups of any size.

Equal values are counted before the shuffle, and the ordered counts of a group are spread over
coarse value codes (``value_bin``): only the small code histogram of a group is ordered in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numeric import value_bin

Keys = Sequence[str]


def ordered_counts(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``(keys, v, n, before, total)``: multiplicity of each distinct value and rows below it."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
        .withColumn("_bin", value_bin("v"))
    )
    hist = counts.groupBy(*keys, "_bin").agg(F.sum("n").alias("_nb"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    offsets = hist.select(
        *keys,
        "_bin",
        (F.sum("_nb").over(along) - F.col("_nb")).alias("_off"),
        F.sum("_nb").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("v")
    return (
        counts.withColumn("_cum", F.sum("n").over(inside))
        .join(offsets, [*keys, "_bin"])
        .withColumn("before", F.col("_cum") - F.col("n") + F.col("_off"))
        .drop("_cum", "_off", "_bin")
    )


def beside(counts: DataFrame, keys: Keys, value: str, count: str, columns: Sequence[str]) -> DataFrame:
    """Of distinct values with their counts: rows ``before`` each and, as ``next``, the columns of the next larger value.

    Values are ordered inside a value code only; the first value and the rows of each code are stitched along the codes of a group, which
    are few, so no group is ordered in one task.
    """
    own = counts.withColumn("_bin", value_bin(value))
    inside, along = Window.partitionBy(*keys, "_bin").orderBy(value), Window.partitionBy(*keys).orderBy("_bin")
    row = F.struct(*columns)
    borders = own.groupBy(*keys, "_bin").agg(F.min_by(row, value).alias("_first"), F.sum(count).alias("_rows"))
    borders = borders.select(*keys, "_bin", F.lead("_first").over(along).alias("_after"), (F.sum("_rows").over(along) - F.col("_rows")).alias("_off"))
    own = own.withColumn("_next", F.lead(row).over(inside)).withColumn("_cum", F.sum(count).over(inside) - F.col(count))
    j = own.join(borders, [*keys, "_bin"])
    return j.withColumn("next", F.coalesce("_next", "_after")).withColumn("before", F.col("_cum") + F.col("_off")).drop("_bin", "_next", "_after", "_cum", "_off")


def quantiles(df: DataFrame, keys: Keys, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per name of ``probs``, with the row count ``n``.

    Equal values are counted before the shuffle; a group of any size is spread over value codes.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("_bin", value_bin("v"))
    )
    hist = counts.groupBy(*keys, "_bin").agg(F.sum("c").alias("_nb"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    spots = hist.select(
        *keys,
        "_bin",
        (F.sum("_nb").over(along) - F.col("_nb")).alias("_off"),
        F.col("_nb"),
        F.sum("_nb").over(Window.partitionBy(*keys)).alias("n"),
    )

    def rank(p: float, up: bool) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        return (F.ceil(pos) if up else F.floor(pos)).cast("long")

    wanted = F.lit(False)
    for p in probs.values():
        for up in (False, True):
            r = rank(p, up)
            wanted = wanted | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_nb")))
    spots = spots.filter(wanted)
    inside = Window.partitionBy(*keys, "_bin").orderBy("v")
    placed = (
        counts.join(spots, [*keys, "_bin"])
        .withColumn("_hi", F.sum("c").over(inside) + F.col("_off"))
        .withColumn("_lo", F.col("_hi") - F.col("c"))
    )

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("v")))

    aggs = [F.max("n").alias("n")]
    for name, p in probs.items():
        aggs += [at(rank(p, False)).alias(f"_a_{name}"), at(rank(p, True)).alias(f"_b_{name}")]
    out = placed.groupBy(*keys).agg(*aggs)
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        out = out.withColumn(
            name,
            F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (pos - F.floor(pos)),
        )
    return out.select(*keys, "n", *probs)


def deviations(df: DataFrame, keys: Keys, value: str, centre: DataFrame, mid: str, out: str) -> DataFrame:
    """Absolute deviation of every row from the centre of its group."""
    return df.join(centre.select(*keys, mid), list(keys)).withColumn(out, F.abs(F.col(value) - F.col(mid)))


def median_mad(
    df: DataFrame,
    keys: Keys,
    value: str,
    probs: Mapping[str, float] | None = None,
) -> DataFrame:
    """Quantiles plus ``median`` and the scaled median absolute deviation ``mad`` (factor 1.4826)."""
    q = quantiles(df, keys, value, {**(probs or {}), "median": 0.5})
    dev = deviations(df.filter(F.col(value).isNotNull()), keys, value, q, "median", "_dev")
    m = quantiles(dev, keys, "_dev", {"_mad": 0.5})
    return q.join(m.select(*keys, (F.col("_mad") * 1.4826).alias("mad")), list(keys))


def modal_value(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Most frequent value, its count and the number of finite cells; ties go to the smallest value."""
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    )
    return counts.groupBy(*keys).agg(
        F.max_by(F.col(value), F.struct("_c", -F.col(value))).alias("mode_value"),
        F.max("_c").alias("mode_count"),
        F.sum("_c").alias("n_finite"),
        F.count("*").alias("n_unique"),
    )


def kneedle(imp: DataFrame, feature: str, weight: str) -> DataFrame:
    """Cumulative share of features by falling weight and the knee of that curve (first on ties).

    Features are the columns of one table, so their list is small.
    """
    w = Window.partitionBy().orderBy(F.desc(weight), feature)
    whole = Window.partitionBy()
    out = (
        imp.withColumn("rank", F.row_number().over(w))
        .withColumn("n_features", F.count("*").over(whole))
        .withColumn("cum", F.sum(weight).over(w) / F.sum(weight).over(whole))
    )
    lift = F.col("cum") - (F.col("rank") - 1) / F.greatest(F.col("n_features") - 1, F.lit(1))
    best = F.max_by("rank", F.struct(lift, -F.col("rank"))).over(whole)
    return out.withColumn("is_knee", F.col("rank") == best)
