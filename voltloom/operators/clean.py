"""Placeholders and outliers as masks over the gridded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import CLEAN
from voltloom.functions import names
from voltloom.operators import ranks, seq

CH = ["meter_id", "variable"]
CURRENTS = ("i_an", "i_bn", "i_cn")


def global_floors(samples: DataFrame) -> DataFrame:
    """Placeholder value per variable over all meters, where one value dominates every other.

    Dominance over the second count leaves at most the most frequent value, so no ranking of all values
    is needed: two aggregates of the value counts do.
    """
    r = CLEAN
    counts = (
        samples.filter(F.col("value").isNotNull())
        .groupBy("variable", F.bround("value", 6).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    top = counts.groupBy("variable").agg(
        F.max_by("v", F.struct("c", -F.col("v"))).alias("floor_value"), F.max("c").alias("n_floor"),
        F.sum("c").alias("n_finite"), F.count("*").alias("n_distinct"),
    )
    second = (
        counts.join(top.select("variable", "floor_value"), "variable").filter("v <> floor_value")
        .groupBy("variable").agg(F.max("c").alias("second"))
    )
    j = top.join(second, "variable", "left").withColumn("second", F.coalesce("second", F.lit(0)))
    need = F.greatest(F.lit(r.floor_min_count), F.floor(F.col("n_finite") * r.floor_min_share))
    lead = F.greatest(F.greatest("second", F.lit(1)) * r.floor_dominance, F.lit(50))
    ok = (F.col("n_finite") >= 50) & (F.col("n_distinct") >= 2) & (F.col("n_floor") >= need) & (F.col("n_floor") >= lead)
    return j.filter(ok).select("variable", "floor_value", "n_floor", "n_finite", "second")


def exact_floor(samples: DataFrame, floors: DataFrame) -> DataFrame:
    """Samples with the flag ``exact``; one floor per variable joins as a small table."""
    j = samples.join(F.broadcast(floors.select("variable", "floor_value")), "variable", "left")
    hit = F.abs(F.bround("value", 6) - F.col("floor_value")) <= 5e-6
    return j.withColumn("exact", F.coalesce(hit, F.lit(False))).drop("floor_value")


def low_plateau(flagged: DataFrame, block: int) -> DataFrame:
    """Border of the low plateau per channel: the best scored gap between neighbouring values.

    Input has the flag ``exact``; channels without a confirmed plateau are absent. Values of a channel are
    counted first and ordered by value codes, so no channel is ordered in one task.
    """
    fam = names.family_of("variable")
    use = flagged.filter(F.col("value").isNotNull() & ~F.col("exact") & ~fam.isin("v", "thdv", "hrm_v", "cos"))
    st = ranks.quantiles(use, CH, "value", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    st = st.filter((F.col("n") >= 30) & ~(fam.isin("p", "q") & (F.col("q50") < 0)))
    st = st.withColumn("scale", F.greatest(F.col("q75") - F.col("q25"), F.col("q95") - F.col("q05"), F.lit(1e-9)))
    r3 = F.bround("value", 3)
    g = use.groupBy(*CH, r3.alias("lower")).agg(
        F.count("*").alias("c"),
        F.count_if(F.col("value") <= r3 + 1e-9).alias("c_low"),
        F.count_if(F.col("value") >= r3 - 1e-9).alias("c_up"),
    )
    g = ranks.beside(g, CH, "lower", "c", ["lower", "c", "c_up"]).join(st.select(*CH, "n", "scale"), CH)
    g = g.withColumns({"gap": F.col("next.lower") - F.col("lower"), "next_c": F.col("next.c"), "next_up": F.col("next.c_up")})
    n_low = F.col("before") + F.col("c_low")
    n_up = F.col("n") - F.col("before") - F.col("c") - F.col("next_c") + F.col("next_up")
    share = n_low / F.col("n")
    zero = fam.isin("p", "q", "s", "cos") & (F.abs("lower") <= F.greatest(F.lit(1e-9), 0.002 * F.greatest("scale", F.lit(1.0))))
    ok = (
        F.col("gap").isNotNull() & ~zero & (n_low >= CLEAN.min_run) & (n_up >= CLEAN.min_run) & share.between(0.005, 0.95)
        & (F.col("gap") >= F.greatest(0.03 * F.col("scale"), F.lit(1e-6)))
    )
    score = F.col("gap") * F.least(share, 1.0 - share)
    best = g.filter(ok).withColumn("score", score).groupBy(*CH).agg(F.max_by("lower", F.struct("score", -F.col("lower"))).alias("lower"))
    cand = use.join(best, CH).filter(F.col("value") <= F.col("lower") + 1e-9)
    confirmed = seq.runs(cand, CH, F.lit(True), CLEAN.min_run, block=block).select(*CH).distinct()
    return best.join(confirmed, CH, "left_semi")


def sentinel_mask(samples: DataFrame, floors: DataFrame, block: int) -> DataFrame:
    """Samples with ``exact``, ``low`` and their union ``core``."""
    flagged = exact_floor(samples, floors)
    low = low_plateau(flagged, block)
    hit = F.col("value").isNotNull() & ~F.col("exact") & (F.col("value") <= F.col("lower") + 1e-9)
    out = flagged.join(low, CH, "left").withColumn("low", F.coalesce(hit, F.lit(False))).drop("lower")
    return out.withColumn("core", F.col("exact") | F.col("low"))


def current_sentinel(samples: DataFrame, floors: DataFrame, block: int) -> DataFrame:
    """``(meter_id, x)`` without a reading, judged on the three currents of a meter together.

    Anchors are steps where a current sits on its floor while all three are known. Anchors less than the
    bridge apart form segments, accepted whole when two phases stand apart from their context and are flat.
    Meters without anchors fall back to a low plateau in all three phases.
    """
    r = CLEAN
    cur = samples.filter(F.col("variable").isin(*CURRENTS))
    flagged = exact_floor(cur, floors)
    steps = flagged.groupBy("meter_id", "x").agg(
        (F.count("value") == 3).alias("full"), F.max("exact").alias("hit")
    )
    anchors = steps.filter("full and hit").select("meter_id", "x")
    segs = seq.close_gaps(anchors, ["meter_id"], F.lit(True), r.bridge, r.min_run, block=block)
    phases = segs.select("meter_id", "x0", "x1", F.explode(F.array(*[F.lit(c) for c in CURRENTS])).alias("variable"))
    known = cur.filter(F.col("value").isNotNull())
    keys = [*CH, "x0", "x1"]
    inner = seq.interval_points(phases, CH, "x0", "x1").join(known, [*CH, "x"])
    marks = {"q05": 0.05, "q25": 0.25, "med": 0.5, "q75": 0.75, "q95": 0.95}
    seg = ranks.quantiles(inner, keys, "value", {"q25": 0.25, "med": 0.5, "q75": 0.75})
    near = seq.context_points(phases, CH, r.context).join(known, [*CH, "x"])
    n_near = near.groupBy(*keys).agg(F.count("*").alias("n_near"))
    thin = phases.join(n_near, keys, "left").filter(F.coalesce("n_near", F.lit(0)) < r.min_context).select(*keys)
    rest = thin.join(known, CH).filter((F.col("x") < F.col("x0")) | (F.col("x") > F.col("x1"))).select(*keys, "value")
    ctx = near.join(thin, keys, "left_anti").select(*keys, "value").unionByName(rest)
    stats = ranks.median_mad(ctx, keys, "value", marks).select(
        *keys, *[F.col(c).alias(f"c_{c}") for c in ("n", "mad", *marks) if c != "med"], F.col("median").alias("c_med")
    )
    iqr_c = F.greatest(F.col("c_q75") - F.col("c_q25"), F.lit(0.0))
    iqr_s = F.when(F.col("n") >= 4, F.greatest(F.col("q75") - F.col("q25"), F.lit(0.0))).otherwise(F.lit(0.0))
    scale = F.greatest(F.col("c_mad"), 0.15 * iqr_c, F.lit(1e-6))
    amp = F.greatest(F.col("c_q95") - F.col("c_q05"), iqr_c, F.lit(1e-9))
    contrast = F.abs(F.col("med") - F.col("c_med")) >= F.greatest(r.z * scale, r.amp_share * amp)
    flat = iqr_s <= F.greatest(r.flat_ratio * F.greatest(iqr_c, F.lit(1e-9)), 3.0 * scale)
    tested = seg.join(stats, keys).withColumn(
        "passed", (F.col("n") >= r.min_run) & (F.col("c_n") >= r.min_context) & contrast & flat
    )
    good = tested.groupBy("meter_id", "x0", "x1").agg(F.count_if("passed").alias("k")).filter("k >= 2")
    whole = seq.interval_points(good, ["meter_id"])
    bare = steps.groupBy("meter_id").agg(F.max(F.col("full") & F.col("hit")).alias("any"), F.max("full").alias("f")).filter("not any and f")
    plain = cur.withColumn("exact", F.lit(False)).join(bare.select("meter_id"), "meter_id", "left_semi")
    low = low_plateau(plain, block)
    lows = (
        plain.join(low, CH).filter(F.col("value") <= F.col("lower") + 1e-9)
        .groupBy("meter_id", "x").agg(F.count("*").alias("k")).filter("k = 3").select("meter_id", "x")
    )
    fallback = seq.interval_points(seq.runs(lows, ["meter_id"], F.lit(True), r.min_run, block=block), ["meter_id"])
    return anchors.unionByName(whole).unionByName(fallback).distinct()


def propagate(samples: DataFrame, dead_steps: DataFrame, block: int) -> DataFrame:
    """Known cells at the dead steps of their meter, with one known neighbour at both ends of longer runs."""
    known = samples.filter(F.col("value").isNotNull()).select(*CH, "x")
    core = known.join(dead_steps, ["meter_id", "x"])
    edges = seq.pad_edges(seq.runs(core, CH, F.lit(True), block=block), CH).join(known, [*CH, "x"], "left_semi")
    return core.select(*CH, "x").unionByName(edges.select(*CH, "x")).distinct()


def main_lock(samples: DataFrame, mask: DataFrame, main: int) -> DataFrame:
    """Known cells of the other meters at steps where the main meter reads nothing useful."""
    lead = samples.filter((F.col("meter_id") == main) & names.family_of("variable").isin("i", "p"))
    m = mask.filter(F.col("meter_id") == main).select("variable", "x", F.lit(True).alias("_m"))
    bad = F.col("value").isNull() | F.col("_m").isNotNull()
    steps = (
        lead.join(m, ["variable", "x"], "left")
        .groupBy("x").agg(
            F.min(F.when(names.family_of("variable") == "i", bad)).alias("i"),
            F.min(F.when(names.family_of("variable") == "p", bad)).alias("p"),
        )
        .filter("i or p").select("x")
    )
    return samples.filter((F.col("meter_id") != main) & F.col("value").isNotNull()).join(steps, "x", "left_semi").select(*CH, "x")


def outliers(samples: DataFrame, mask: DataFrame, gap_flag: Column, block: int) -> DataFrame:
    """``(meter_id, variable, x, value)`` of short extreme events.

    The reference excludes masks, gaps and their surroundings; masked cells are never outliers, but cells
    close to a gap may be.
    """
    r = CLEAN
    m = mask.select(*CH, "x", F.lit(True).alias("_m")).distinct()
    s = samples.join(m, [*CH, "x"], "left").withColumn("masked", F.col("_m").isNotNull()).drop("_m")
    s = s.withColumn("_bad", F.col("masked") | gap_flag)
    s = seq.dilate(s, CH, "_bad", r.forbidden_radius, "_near", block=block)
    s = s.withColumn("ref", F.when(~F.col("_near"), F.col("value")))
    g = ranks.median_mad(s, CH, "ref", {"q1": 0.25, "q3": 0.75}).filter(F.col("n") >= r.min_reference)
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.0))
    g = g.select(
        *CH, F.greatest(iqr, F.col("mad"), F.lit(1e-9)).alias("scale"),
        F.when(iqr > 0, F.col("q1") - r.envelope_k * iqr).otherwise(F.col("median") - r.envelope_k * F.greatest("mad", F.lit(1e-9))).alias("lo"),
        F.when(iqr > 0, F.col("q3") + r.envelope_k * iqr).otherwise(F.col("median") + r.envelope_k * F.greatest("mad", F.lit(1e-9))).alias("hi"),
    )
    s = seq.rolling_median(s, CH, "ref", "_med", r.hampel_half, r.hampel_min, block=block)
    s = s.withColumn("_dev", F.abs(F.col("ref") - F.col("_med")))
    s = seq.rolling_median(s, CH, "_dev", "_mad", r.hampel_half, r.hampel_min, block=block)
    j = s.filter(F.col("value").isNotNull() & ~F.col("masked")).join(g, CH)
    res = F.abs(F.col("value") - F.col("_med"))
    floor = F.greatest(0.05 * F.col("scale"), F.lit(1e-9))
    z = res / F.when(F.col("_mad").isNull(), F.lit(None)).otherwise(F.greatest(1.4826 * F.col("_mad"), floor))
    local = (z >= r.hampel_z) & (res >= F.greatest(r.min_jump * F.col("scale"), F.lit(1e-9)))
    extreme = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    raw = j.filter(F.coalesce(local, F.lit(False)) | extreme).select(*CH, "x", "value")
    short = seq.runs(raw, CH, F.lit(True), block=block).filter(F.col("n") <= r.outlier_run)
    return seq.interval_points(short, CH).join(raw, [*CH, "x"])


def apply_masks(samples: DataFrame, sentinels: DataFrame, points: DataFrame) -> DataFrame:
    """Samples with sentinel cells blanked (``no_sentinel``) and outliers blanked as well (``clean``)."""
    s = sentinels.select(*CH, "x", F.lit(True).alias("_s")).distinct()
    o = points.select(*CH, "x", F.lit(True).alias("_o")).distinct()
    j = samples.join(s, [*CH, "x"], "left").join(o, [*CH, "x"], "left")
    return j.withColumn("no_sentinel", F.when(F.col("_s").isNull(), F.col("value"))).withColumn(
        "clean", F.when(F.col("_s").isNull() & F.col("_o").isNull(), F.col("value"))
    ).drop("_s", "_o")
