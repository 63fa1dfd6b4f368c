"""Aggregates over series: counts, energies, regressions, histograms, subtotals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numeric import safe_corr

Keys = Sequence[str]

# fixed values: gates of the modal floor
FLOOR_SHARE, FLOOR_COUNT, MIN_POINTS = 0.02, 20, 10


def is_floor() -> Column:
    """Gate on the columns of ``modal_value``: the mode is a placeholder, not a reading."""
    c, n = F.col("mode_count"), F.col("n_finite")
    return (n >= MIN_POINTS) & (c >= FLOOR_SHARE * n) & (c >= FLOOR_COUNT)


def comma_share(df: DataFrame, columns: Keys) -> DataFrame:
    """Share of the texts of each column written with a decimal comma."""
    hit = [F.avg(F.col(c).rlike(r"^-?\d+,\d+$").cast("double")).alias(c) for c in columns]
    return df.agg(*hit).unpivot([], list(columns), "column_name", "pct")


def null_inventory(df: DataFrame, columns: Keys) -> DataFrame:
    """Rows and NULL cells per column, in one pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return df.agg(F.count("*").alias("n_rows"), *counts).unpivot(["n_rows"], list(columns), "column_name", "n_null")


def gram(y: Column, xs: Sequence[Column]) -> list[tuple[str, Column]]:
    """Named covariance aggregates of a regression, over rows that hold every value."""
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    cols = [F.when(ok, x.cast("double")) for x in xs]
    yy = F.when(ok, y.cast("double"))
    out = [("n", F.count(yy)), ("syy", F.var_pop(yy))]
    for i, a in enumerate(cols):
        out.append((f"sy{i}", F.covar_pop(yy, a)))
        for j in range(i, len(cols)):
            out.append((f"s{i}{j}", F.covar_pop(a, cols[j])))
    return out


def r2_multi(df: DataFrame, keys: Keys, y: Column, xs: Sequence[Column], min_n: int = MIN_POINTS) -> DataFrame:
    """Share of the variance of ``y`` explained by up to four regressors with intercept.

    One pass of covariances per group, then elimination on the small matrix as column arithmetic; a
    regressor that the ones before it explain fully is left out.
    """
    out = df.groupBy(*keys).agg(*[c.alias(f"_{n}") for n, c in gram(y, xs)])
    return solve_r2(out, len(xs), min_n).select(*keys, F.col("_n").alias("n"), "r2")


def solve_r2(out: DataFrame, k: int, min_n: int = MIN_POINTS) -> DataFrame:
    """Add ``r2`` to a table that holds the ``gram`` columns with a leading underscore."""
    for i in range(k):
        out = out.withColumn(f"_v{i}", F.col(f"_s{i}{i}"))
    for p in range(k):
        live = F.col(f"_s{p}{p}") > 1e-10 * F.col(f"_v{p}")
        gain = F.when(live, F.col(f"_sy{p}") * F.col(f"_sy{p}") / F.col(f"_s{p}{p}")).otherwise(F.lit(0.0))
        step = {f"_g{p}": gain}
        factor = lambda i: F.when(live, F.col(f"_s{p}{i}") / F.col(f"_s{p}{p}")).otherwise(F.lit(0.0))  # noqa: B023, E731
        for i in range(p + 1, k):
            step[f"_sy{i}"] = F.col(f"_sy{i}") - factor(i) * F.col(f"_sy{p}")
            for j in range(i, k):
                step[f"_s{i}{j}"] = F.col(f"_s{i}{j}") - factor(i) * F.col(f"_s{p}{j}")
        out = out.withColumns(step)
    explained = sum((F.col(f"_g{p}") for p in range(k)), F.lit(0.0))
    r2 = F.when((F.col("_n") >= min_n) & (F.col("_syy") > 0), explained / F.nullif(F.col("_syy"), F.lit(0.0)))
    return out.withColumn("r2", r2)


def signed_corr(df: DataFrame, keys: Keys, y: Column, x: Column, min_n: int = MIN_POINTS) -> DataFrame:
    """Sign of the correlation, 0 where it is undefined."""
    ok = y.isNotNull() & x.isNotNull()
    r = safe_corr(y, x)
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n"), r.alias("r")).withColumn(
        "sgn", F.when((F.col("n") >= min_n) & F.col("r").isNotNull(), F.signum("r")).otherwise(0).cast("int")
    )


def energy_uniform(df: DataFrame, keys: Keys, power: Column, step_hours: float, per_kw: float = 1000.0) -> DataFrame:
    """Energy of an evenly spaced series: power sum x step; zero where all is missing."""
    return df.groupBy(*keys).agg((F.coalesce(F.sum(power), F.lit(0.0)) * step_hours / per_kw).alias("kwh"))


def energy_trapezoid(
    df: DataFrame, keys: Keys, time: str, power: str, slot_hours: int = 24, cap_seconds: float = 300.0
) -> DataFrame:
    """Energy of an uneven series by trapezoids whose base is cut at ``cap_seconds``.

    Series are cut into time slots; the first row of each slot is joined to the last row of the slot
    before through one small row per slot.
    """
    slot = F.floor(F.unix_micros(time) / F.lit(slot_hours * 3_600_000_000)).cast("long")
    rows = df.filter(F.col(power).isNotNull() & F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("t"), F.col(power).cast("double").alias("p"), slot.alias("slot")
    )
    w = Window.partitionBy(*keys, "slot").orderBy("t")

    def area(p1, t1) -> Column:
        dt = (F.unix_micros(t1) - F.unix_micros("t")) / F.lit(1e6)
        return 0.5 * (F.col("p") + p1) * F.least(F.greatest(dt, F.lit(0.0)), F.lit(cap_seconds))

    inside = rows.withColumn("_a", area(F.lead("p").over(w), F.lead("t").over(w)))
    parts = inside.groupBy(*keys, "slot").agg(
        F.sum("_a").alias("a"), F.min(F.struct("t", "p")).alias("lo"), F.max(F.struct("t", "p")).alias("hi")
    )
    along = Window.partitionBy(*keys).orderBy("slot")
    nxt = F.lead("lo").over(along)
    parts = parts.select(*keys, "a", F.col("hi.t").alias("t"), F.col("hi.p").alias("p"), nxt.alias("nxt"))
    parts = parts.withColumn("_b", area(F.col("nxt.p"), F.col("nxt.t")))
    total = F.sum(F.coalesce("a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)))
    return parts.groupBy(*keys).agg((F.coalesce(total, F.lit(0.0)) / 3.6e6).alias("kwh"))


def class_counts(df: DataFrame, cls: str, flags: Mapping[str, Column]) -> DataFrame:
    """Rows and percentage per class, plus counts of flags."""
    out = df.groupBy(cls).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return out.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def pseudo_meter(wide: DataFrame, members: Sequence[int], variables: Keys, new_id: int, active: Column) -> DataFrame:
    """One meter out of several: additive quantities summed, the rest averaged, over the active members."""
    additive = ("i_", "p_", "q_", "s_", "hrm_i_")
    aggs = [(F.sum(v) if v.startswith(additive) else F.avg(v)).alias(v) for v in variables]
    on = wide.filter(F.col("meter_id").isin(list(members)) & active)
    return on.groupBy("x").agg(*aggs).withColumn("meter_id", F.lit(new_id))


def component_count(wide: DataFrame, active: Column, power: Column) -> DataFrame:
    """Grid steps and power by the number of active components."""
    per = wide.filter(active).groupBy("x").agg(F.count_distinct("meter_id").alias("c"), F.sum(power).alias("p"))
    return per.groupBy("c").agg(F.count("*").alias("n_steps"), F.sum("p").alias("power"))


def subtotals(df: DataFrame, levels: Mapping[str, str], aggs: Mapping[str, Column]) -> DataFrame:
    """Rollup whose collapsed levels read ``ALL``."""
    out = df.rollup(*levels.values()).agg(
        *[c.alias(n) for n, c in aggs.items()], *[F.grouping(c).alias(f"_g_{n}") for n, c in levels.items()]
    )
    shown = [F.when(F.col(f"_g_{n}") == 1, "ALL").otherwise(F.col(c)).alias(n) for n, c in levels.items()]
    return out.select(*shown, *aggs)


def log_edges(decades: float, bins: int) -> list[int]:
    """Distinct integer edges spaced evenly in the logarithm."""
    return sorted({int(10 ** (decades * i / bins) + 1e-9) for i in range(bins + 1)})


def log_histogram(df: DataFrame, value: str, decades: float, bins: int) -> DataFrame:
    """Counts per log-spaced bin; the right edge belongs to the last bin, empty bins are shown."""
    edges = log_edges(decades, bins)
    last = len(edges) - 1
    pos = F.lit(None).cast("int")
    for i in range(last, 0, -1):
        up = F.col(value) <= edges[i] if i == last else F.col(value) < edges[i]
        pos = F.when((F.col(value) >= edges[i - 1]) & up, F.lit(i)).otherwise(pos)
    hits = df.select(pos.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n_gaps"))
    all_bins = df.sparkSession.createDataFrame(
        [(i, edges[i - 1], edges[i]) for i in range(1, len(edges))], "bin int, lo long, hi long"
    )
    return all_bins.join(hits, "bin", "left").na.fill(0, ["n_gaps"])


def longest_equal_run(known: DataFrame, keys: Keys, value: str, x: str = "x", block: int = 10_080) -> DataFrame:
    """Longest stretch of equal consecutive values, over rows that all hold a value.

    Rows are counted within a block; each block then yields its longest inner run and the runs at its
    two ends, which are joined along the series.
    """
    w = Window.partitionBy(*keys, "_blk").orderBy(x)
    rows = known.withColumn("_blk", F.floor(F.col(x) / block).cast("long"))
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = rows.withColumn("_new", change).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = rows.groupBy(*keys, "_blk", "_run").agg(F.first(value).alias("_v"), F.count("*").alias("_n"))
    ends = Window.partitionBy(*keys, "_blk").orderBy("_run")
    edge = F.lag("_run").over(ends).isNull() | F.lead("_run").over(ends).isNull()
    pieces = pieces.withColumn("_edge", edge)
    along = Window.partitionBy(*keys).orderBy("_blk", "_run")
    border = (
        pieces.filter("_edge")
        .withColumn("_prev_v", F.lag("_v").over(along))
        .withColumn("_prev_blk", F.lag("_blk").over(along))
        .withColumn("_same", F.col("_prev_v").eqNullSafe(F.col("_v")) & (F.col("_prev_blk") < F.col("_blk")))
        .withColumn("_grp", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(along))
        .groupBy(*keys, "_grp")
        .agg(F.sum("_n").alias("_n"))
    )
    every = pieces.filter(~F.col("_edge")).select(*keys, "_n").unionByName(border.select(*keys, "_n"))
    return every.groupBy(*keys).agg(F.max("_n").alias("longest"))


def minmax_scale(df: DataFrame, keys: Keys, value: str, train: Column) -> DataFrame:
    """Scale by the range of the training rows; a constant column keeps scale 1."""
    fit = df.filter(train).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    return df.join(fit, list(keys)).withColumn("scaled", (F.col(value) - F.col("lo")) / width)


def minmax_unscale(df: DataFrame, scaled: str, out: str) -> DataFrame:
    """Inverse of ``minmax_scale`` for rows that carry ``lo`` and ``hi``."""
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    return df.withColumn(out, F.col(scaled) * width + F.col("lo"))
