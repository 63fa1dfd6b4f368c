"""Sequence operators on a dense integer axis.

Every series is cut into blocks of ``block`` grid steps and each window runs inside one
``(series, block)``; a frame that looks over a block border gets the neighbouring rows as halo
copies, and whatever is unbounded (runs, nearest neighbours, running totals) is stitched from one
summary row per block. So a single series may hold any share of the table without filling one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_080  # one week of minutes

Keys = Sequence[str]


def with_block(df: DataFrame, x: str = "x", block: int = BLOCK) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(x) / block).cast("long"))


def with_halo(df: DataFrame, before: int, after: int, x: str = "x", block: int = BLOCK) -> DataFrame:
    """Copy each row into every block whose frames ``[-before, +after]`` can see it."""
    own = F.floor(F.col(x) / block).cast("long")
    first = F.floor((F.col(x) - after) / block).cast("long")
    last = F.floor((F.col(x) + before) / block).cast("long")
    return df.withColumn("_own", own).withColumn("_blk", F.explode(F.sequence(first, last)))


def framed(
    df: DataFrame, keys: Keys, columns: dict, before: int, after: int, x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Add window columns. Each value is a function of the ordered window specification."""
    w = Window.partitionBy(*keys, "_blk").orderBy(x)
    out = with_halo(df, before, after, x, block)
    for name, build in columns.items():
        out = out.withColumn(name, build(w))
    return out.filter("_blk = _own").drop("_blk", "_own")


def runs(
    df: DataFrame, keys: Keys, flag: Column, min_run: int = 1, x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Contiguous blocks of true flags as ``(keys, x0, x1, n)``."""
    w = Window.partitionBy(*keys, "_blk").orderBy(x)
    pieces = (
        with_block(df.filter(flag).select(*keys, x), x, block)
        .withColumn("_isle", F.col(x) - F.row_number().over(w))
        .groupBy(*keys, "_blk", "_isle")
        .agg(F.min(x).alias("x0"), F.max(x).alias("x1"))
        .select(*keys, "x0", "x1")
    )
    return merge_intervals(pieces, keys, 0, block, min_run)


def merge_intervals(
    pieces: DataFrame, keys: Keys, bridge: int = 0, block: int = BLOCK, min_run: int = 1
) -> DataFrame:
    """Join disjoint intervals whose hole is at most ``bridge`` steps.

    Intervals are first merged inside their block; only the first and last of each block can touch
    another block, so stitching along the whole series sees at most two rows per block.
    """
    lead_in = Window.partitionBy(*keys, "_blk").orderBy("x0")

    def fuse(df: DataFrame, part: Keys, w) -> DataFrame:
        hole = F.col("x0") - F.lag("x1").over(w) - 1
        return (
            df.withColumn("_new", F.when(hole <= bridge, 0).otherwise(1))
            .withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*part, "_grp")
            .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
            .drop("_grp")
        )

    inner = fuse(
        pieces.withColumn("_blk", F.floor(F.col("x0") / block).cast("long")), [*keys, "_blk"], lead_in
    )
    edge = F.lag("x0").over(lead_in).isNull() | F.lead("x0").over(lead_in).isNull()
    inner = inner.withColumn("_edge", edge)
    border = fuse(inner.filter("_edge"), keys, Window.partitionBy(*keys).orderBy("x0"))
    done = inner.filter(~F.col("_edge")).select(*keys, "x0", "x1").unionByName(border)
    return done.withColumn("n", (F.col("x1") - F.col("x0") + 1).cast("long")).filter(F.col("n") >= min_run)


def interval_points(intervals: DataFrame, keys: Keys, *extra: str, x: str = "x") -> DataFrame:
    """One row per grid step of every interval."""
    return intervals.select(*keys, *extra, F.explode(F.sequence("x0", "x1")).alias(x))


def close_gaps(
    df: DataFrame, keys: Keys, flag: Column, bridge: int, min_run: int = 1, x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Runs of a flag after filling false holes of at most ``bridge`` steps between true blocks."""
    return merge_intervals(runs(df, keys, flag, 1, x, block), keys, bridge, block, min_run)


def running(
    df: DataFrame, keys: Keys, totals: dict[str, Column], x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Running sums along a series: sums inside the block plus the carry of the blocks before."""
    w = Window.partitionBy(*keys, "_blk").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    blocked = with_block(df, x, block)
    sums = blocked.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_c_{n}") for n, c in totals.items()])
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_c_{n}").over(prior), F.lit(0)).alias(f"_c_{n}") for n in totals]
    )
    out = blocked
    for n, c in totals.items():
        out = out.withColumn(n, F.sum(c).over(w))
    out = out.join(carry, [*keys, "_blk"])
    for n in totals:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)) + F.col(f"_c_{n}"))
    return out.drop("_blk", *[f"_c_{n}" for n in totals])


def neighbours(
    df: DataFrame, keys: Keys, value: Column, x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Add ``prev_x, prev_v, next_x, next_v``: nearest rows at or before / after with a value."""
    known = F.when(value.isNotNull(), F.struct(F.col(x).alias("x"), value.alias("v")))
    w = Window.partitionBy(*keys, "_blk").orderBy(x)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    blocked = with_block(df, x, block).withColumn("_k", known)
    ends = blocked.groupBy(*keys, "_blk").agg(F.max("_k").alias("_hi"), F.min("_k").alias("_lo"))
    along = Window.partitionBy(*keys).orderBy("_blk")
    carry = ends.select(
        *keys,
        "_blk",
        F.last("_hi", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_pc"),
        F.first("_lo", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_nc"),
    )
    return (
        blocked.withColumn("_p", F.last("_k", True).over(back))
        .withColumn("_n", F.first("_k", True).over(ahead))
        .join(carry, [*keys, "_blk"])
        .withColumn("_p", F.coalesce("_p", "_pc"))
        .withColumn("_n", F.coalesce("_n", "_nc"))
        .withColumn("prev_x", F.col("_p.x"))
        .withColumn("prev_v", F.col("_p.v"))
        .withColumn("next_x", F.col("_n.x"))
        .withColumn("next_v", F.col("_n.v"))
        .drop("_blk", "_k", "_p", "_n", "_pc", "_nc")
    )


def interpolate(df: DataFrame, keys: Keys, value: str, out: str, x: str = "x", block: int = BLOCK) -> DataFrame:
    """Linear interpolation over missing values; the nearest value is held at both ends."""
    span = F.nullif(F.col("next_x") - F.col("prev_x"), F.lit(0))
    line = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * (F.col(x) - F.col("prev_x")) / span
    near = neighbours(df, keys, F.col(value), x, block)
    return near.withColumn(out, F.coalesce(F.col(value), line, F.col("prev_v"), F.col("next_v"))).drop(
        "prev_x", "prev_v", "next_x", "next_v"
    )


def dilate(df: DataFrame, keys: Keys, flag: str, radius: int, out: str, x: str = "x", block: int = BLOCK) -> DataFrame:
    """True where any row within ``radius`` steps is true."""
    near = lambda w: F.max(F.col(flag)).over(w.rowsBetween(-radius, radius))
    return framed(df, keys, {out: near}, radius, radius, x, block)


def pad_edges(intervals: DataFrame, keys: Keys, min_run: int = 3, radius: int = 1) -> DataFrame:
    """Points next to both ends of the intervals of at least ``min_run`` steps, as ``(keys, x)``."""
    left = F.sequence(F.col("x0") - radius, F.col("x0") - 1)
    right = F.sequence(F.col("x1") + 1, F.col("x1") + radius)
    return (
        intervals.filter(F.col("n") >= min_run)
        .select(*keys, F.explode(F.concat(left, right)).alias("x"))
        .filter("x >= 0")
        .distinct()
    )


def rolling_median(
    df: DataFrame, keys: Keys, value: str, out: str, half: int = 30, min_n: int = 21, x: str = "x", block: int = BLOCK
) -> DataFrame:
    """Centred running median over ``2 half + 1`` rows, NULL below ``min_n`` known values."""

    def build(w):
        frame = w.rowsBetween(-half, half)
        return F.when(F.count(value).over(frame) >= min_n, F.percentile(F.col(value), F.lit(0.5)).over(frame))

    return framed(df, keys, {out: build}, half, half, x, block)


def time_steps(df: DataFrame, keys: Keys, time: str, slot_hours: int = 24) -> DataFrame:
    """Seconds between consecutive rows of a series; slots of time are joined through their end rows."""
    slot = F.floor(F.unix_micros(time) / F.lit(slot_hours * 3_600_000_000)).cast("long")
    rows = df.filter(F.col(time).isNotNull()).select(*keys, F.unix_micros(time).alias("t"), slot.alias("slot"))
    w = Window.partitionBy(*keys, "slot").orderBy("t")
    inside = rows.select(*keys, ((F.col("t") - F.lag("t").over(w)) / F.lit(1e6)).alias("dt"))
    ends = rows.groupBy(*keys, "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    along = Window.partitionBy(*keys).orderBy("slot")
    across = ends.select(*keys, ((F.col("lo") - F.lag("hi").over(along)) / F.lit(1e6)).alias("dt"))
    return inside.unionByName(across).filter("dt is not null")


def context_points(segments: DataFrame, keys: Keys, reach: int) -> DataFrame:
    """The up to ``reach`` steps before and after each segment, as ``(keys, x0, x1, x)``."""
    left = F.sequence(F.greatest(F.col("x0") - reach, F.lit(0)), F.col("x0") - 1)
    left = F.when(F.col("x0") > 0, left).otherwise(F.array().cast("array<bigint>"))
    right = F.sequence(F.col("x1") + 1, F.col("x1") + reach)
    return segments.select(*keys, "x0", "x1", F.explode(F.concat(left, right)).alias("x"))


def windows(df: DataFrame, keys: Keys, columns: Keys, width: int, stride: int = 1, x: str = "x", block: int = BLOCK) -> DataFrame:
    """Full windows of ``width`` consecutive rows, one array of rows per start."""

    def rows(w):
        return F.collect_list(F.struct(*columns)).over(w.rowsBetween(0, width - 1))

    out = framed(df, keys, {"window": rows}, 0, width - 1, x, block)
    return out.filter((F.size("window") == width) & (F.pmod(F.col(x), F.lit(stride)) == 0)).select(
        *keys, F.col(x).alias("window_idx"), "window"
    )


def unwindow(windowed: DataFrame, keys: Keys, columns: Keys, x: str = "x") -> DataFrame:
    """Rows back from windows; the copies of a row agree, the one from the earliest window is kept."""
    rows = windowed.select(*keys, "window_idx", F.posexplode("window").alias("_pos", "_row"))
    rows = rows.withColumn(x, F.col("window_idx") + F.col("_pos"))
    return rows.groupBy(*keys, x).agg(F.min_by("_row", "window_idx").alias("_row")).select(
        *keys, x, *[F.col("_row")[c].alias(c) for c in columns]
    )


def ordinals(instants: DataFrame, x: str = "x", block: int = BLOCK) -> DataFrame:
    """Zero-based rank of each distinct instant, without sorting them in one place."""
    one = running(instants.select(x).distinct(), [], {"ordinal": F.lit(1)}, x, block)
    return one.withColumn("ordinal", (F.col("ordinal") - 1).cast("long"))


def chronological_split(ranked: DataFrame, total: DataFrame, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Add ``split`` from the ordinal; borders are truncated to whole rows. ``total`` has one row ``n_total``."""
    n = F.col("n_total")
    a = F.floor(n * F.lit(train))
    b = a + F.floor(n * F.lit(valid))
    split = F.when(F.col("ordinal") < a, "train").when(F.col("ordinal") < b, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", split).drop("n_total")


def direction_changes(df: DataFrame, keys: Keys, value: str, x: str = "x", block: int = BLOCK) -> DataFrame:
    """Share of interior rows where the direction of a series without holes changes."""

    def turn(w):
        d1 = F.signum(F.col(value) - F.lag(value).over(w))
        d0 = F.signum(F.lag(value).over(w) - F.lag(value, 2).over(w))
        return F.when(d0.isNotNull() & d1.isNotNull(), (d0 != d1).cast("int"))

    flagged = framed(df, keys, {"_turn": turn}, 2, 0, x, block)
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("_turn") / F.nullif(F.count("_turn"), F.lit(0)), F.lit(0.0)).alias("freq"),
    )


def detrend_runs(df: DataFrame, keys: Keys, value: str, pieces: DataFrame, x: str = "x") -> DataFrame:
    """Deviation from the chord of each run; ``pieces`` are the runs of known values."""
    ends = (
        pieces.join(df.select(*keys, F.col(x).alias("x0"), F.col(value).alias("_v0")), [*keys, "x0"])
        .join(df.select(*keys, F.col(x).alias("x1"), F.col(value).alias("_v1")), [*keys, "x1"])
    )
    points = interval_points(ends, keys, "x0", "x1", "_v0", "_v1", x=x)
    span = F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    chord = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(x) - F.col("x0")) / span
    return points.join(df, [*keys, x]).withColumn(
        "dev", F.when(F.col("x1") > F.col("x0"), F.col(value) - chord).otherwise(F.lit(0.0))
    ).drop("_v0", "_v1")


def weighted_line(df: DataFrame, keys: Keys, t, y, w) -> DataFrame:
    """Weighted least squares line per group; a flat line where time does not vary."""
    rows = df.withColumns({"_t": t.cast("double"), "_y": y.cast("double"), "_w": w.cast("double")})
    total = F.sum("_w")
    means = rows.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_t")) / total).alias("_tm"), (F.sum(F.col("_w") * F.col("_y")) / total).alias("_ym"))
    dt, dy = F.col("_t") - F.col("_tm"), F.col("_y") - F.col("_ym")  # centred first: raw squares of large times lose their digits
    g = rows.join(means, list(keys)).groupBy(*keys, "_tm", "_ym").agg(F.sum(F.col("_w") * dt * dt).alias("_var"), F.sum(F.col("_w") * dt * dy).alias("_cov"))
    slope = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(F.lit(0.0))
    return g.withColumn("slope", slope).select(*keys, "slope", (F.col("_ym") - F.col("slope") * F.col("_tm")).alias("intercept"))


def stretch(source: DataFrame, keys: Keys, targets: DataFrame, value: str, n_source, x: str = "x") -> DataFrame:
    """Stretch a hole-free reference ``(keys, j, value)`` of ``n_source`` rows over each target interval.

    ``targets`` hold ``(keys, x0, x1, n)``; each target point reads the two source rows around its
    fractional position.
    """
    pts = targets.withColumn("_len", F.col("x1") - F.col("x0") + 1).withColumn(x, F.explode(F.sequence("x0", "x1")))
    pos = F.when(
        F.col("_len") > 1, (F.col(x) - F.col("x0")) / (F.col("_len") - 1) * (n_source - 1)
    ).otherwise(F.lit(0.0))
    pts = pts.withColumn("_pos", pos).withColumn("j", F.floor("_pos").cast("long"))
    up = F.least(F.col("j") + 1, n_source - 1).cast("long")
    lo = source.select(*keys, "j", F.col(value).alias("_lo"))
    hi = source.select(*keys, F.col("j").alias("_j1"), F.col(value).alias("_hi"))
    out = pts.withColumn("_j1", up).join(lo, [*keys, "j"]).join(hi, [*keys, "_j1"])
    return out.withColumn(
        "stretched", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.col("j"))
    ).drop("_lo", "_hi", "_pos", "j", "_j1", "_len")


def arrays(df: DataFrame, keys: Keys, columns: Keys, x: str = "x", block: int = BLOCK) -> DataFrame:
    """One row for each (series, block) of a dense axis: the columns as arrays over the block's steps, NULL where nothing is known."""
    rows = with_block(df.select(*keys, x, *columns), x, block).groupBy(*keys, "_blk")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct(x, *columns))).alias("_rows"))
    return rows.select(*keys, "_blk", *[F.col("_rows")[c].alias(c) for c in columns])


def cut(pieces: DataFrame, ids: Keys, keys: Keys, blocks: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """``(ids, column)``: the values from step ``a`` to ``b`` of every piece ``(ids, a, b)`` as one array.

    A piece meets the one or few block rows it touches, not its steps; empty pieces have no row. ``ids`` hold the series keys.
    """
    touched = F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))
    met = pieces.filter("a <= b").select(*ids, "a", "b", F.explode(touched).alias("_blk")).join(blocks.select(*keys, "_blk", column), [*keys, "_blk"])
    first = F.greatest(F.col("a") - F.col("_blk") * block, F.lit(0))
    last = F.least(F.col("b") - F.col("_blk") * block, F.lit(block - 1))
    part = F.slice(column, (first + 1).cast("int"), (last - first + 1).cast("int"))
    whole = met.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_blk", part.alias("_part")))).alias("_parts"))
    return whole.select(*ids, F.flatten("_parts._part").alias(column))
