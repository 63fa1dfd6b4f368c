"""Which meters enter a study: preliminary quality, decision, duplicates, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.config import SCOPE
from voltloom.functions.numeric import safe_corr
from voltloom.operators import gram, joins, ranks
from voltloom.session import stage

CH = ["meter_id", "variable"]


def prelim_sentinel(cells: DataFrame) -> DataFrame:
    """Rule and sentinel cells per channel from its dominant value and its robust amplitude."""
    r = SCOPE
    known = cells.filter(F.col("value").isNotNull()).withColumn("value", F.bround("value", 6))
    mode = ranks.modal_value(known, CH, "value")
    amp = ranks.quantiles(cells, CH, "value", {"q01": 0.01, "q99": 0.99}).drop("n")
    out = mode.join(amp, CH).withColumn("amp", F.abs(F.col("q99") - F.col("q01")))
    out = out.withColumn("dominant_frac", F.col("mode_count") / F.col("n_finite"))
    rule = (
        F.when(F.col("n_finite") < r.min_finite, "insufficient_finite")
        .when(F.col("dominant_frac") >= r.dominance, "dominant_horizontal_value")
        .when((F.col("n_unique") < r.min_unique) & (F.col("amp") <= r.amp_eps), "constant_or_quasi_constant_column")
        .when(F.col("amp") <= r.amp_eps, "zero_robust_amplitude")
        .otherwise("real_variation")
    )
    out = out.withColumn("rule", rule)
    whole = F.col("rule").isin("constant_or_quasi_constant_column", "zero_robust_amplitude")
    n = F.when(F.col("rule") == "dominant_horizontal_value", F.col("mode_count")).when(whole, F.col("n_finite")).otherwise(F.lit(0))
    return out.select(*CH, "n_finite", "n_unique", F.col("mode_value").alias("dominant_value"), "dominant_frac", "amp", "rule", n.cast("long").alias("n_sentinel"))


def sentinel_cells(cells: DataFrame, verdict: DataFrame) -> DataFrame:
    """Known cells with their preliminary sentinel flag."""
    j = cells.filter(F.col("value").isNotNull()).join(verdict.select(*CH, "rule", "dominant_value"), CH)
    hit = F.when(
        F.col("rule") == "dominant_horizontal_value", F.abs(F.bround("value", 6) - F.col("dominant_value")) <= 1e-6
    ).otherwise(F.col("rule").isin("constant_or_quasi_constant_column", "zero_robust_amplitude"))
    return j.withColumn("sentinel", hit)


def energy_quality(flagged: DataFrame) -> DataFrame:
    """Per meter: finite and sentinel cells, rows with at least one useful cell."""
    rows = flagged.groupBy("meter_id", "x").agg(
        F.count("*").alias("cells"), F.count_if("sentinel").alias("sent"), F.max(~F.col("sentinel")).alias("useful")
    )
    return rows.groupBy("meter_id").agg(
        F.count("*").alias("n_rows"), F.sum("cells").alias("n_finite"), F.sum("sent").alias("n_sentinel"),
        F.count_if("useful").alias("n_useful"),
        (F.sum("sent") * 100.0 / F.sum("cells")).alias("pct_sentinel"),
        (F.count_if("useful") * 100.0 / F.count("*")).alias("pct_useful"),
    )


def decide(quality: DataFrame, main: Sequence[int], candidates: Sequence[int], keep: Sequence[int] = (), drop: Sequence[int] = (), gate_main: bool = False) -> DataFrame:
    """Role of each meter and whether it is processed, with the first failing gate as reason."""
    r = SCOPE
    m = F.col("meter_id")
    role = (
        F.when(m.isin(list(drop)), "excluded_force_drop").when(m.isin(list(keep)), "force_keep")
        .when(m.isin(list(main)), "main").when(m.isin(list(candidates)), "candidate").otherwise("not_candidate")
    )
    top = quality.agg(F.max("n_rows").alias("_top"))
    q = quality.crossJoin(F.broadcast(top)).withColumn("coverage", F.col("n_rows") / F.col("_top")).withColumn("role", role)
    gated = (F.col("role") == "candidate") | ((F.col("role") == "main") & F.lit(gate_main))
    verdict = (
        F.when(gated & (F.col("pct_sentinel") >= r.max_sentinel_pct), "excluded_sentinel")
        .when(gated & (F.col("pct_useful") < r.min_useful_pct), "excluded_useful")
        .when(gated & (F.col("coverage") < r.min_coverage), "excluded_coverage")
        .otherwise(F.col("role"))
    )
    return q.withColumn("verdict", verdict).withColumn("process", F.col("verdict").isin("force_keep", "main", "candidate")).drop("_top", "role")


def every_pair(meters: DataFrame, n: int) -> DataFrame:
    """Every pair ``a < b`` of the report, dealt out by tiles, so that no task holds more than two tiles of meters."""
    tiles = -(-n // gram.TILE)
    own = F.pmod(F.xxhash64("meter_id"), F.lit(tiles)).cast("int")
    all_tiles = F.explode(F.sequence(F.lit(0), F.lit(max(tiles, 1) - 1)))
    left = meters.select(F.col("meter_id").alias("a"), own.alias("ta"), all_tiles.alias("tb"))
    right = meters.select(F.col("meter_id").alias("b"), own.alias("tb"), all_tiles.alias("ta"))
    return left.join(right, ["ta", "tb"]).filter("a < b").select("a", "b")


def duplicate_pairs(wide: DataFrame, currents: Sequence[str], block: int) -> DataFrame:
    """Similarity of all meters of one scope by pairs: overlapping (A) or interleaved (B) duplicates.

    Overlap, correlation and median magnitudes come from blocked matrix products (``gram``): a pair never meets step by step.
    """
    r = SCOPE
    rows = wide.dropna(subset=list(currents)).select(F.col("meter_id").cast("int").alias("meter_id"), "x", *currents)
    per = stage(rows.groupBy("meter_id").agg(F.count("*").alias("n")))
    meters = per.count()
    tiles = stage(gram.tiled(rows.unpivot(["meter_id", "x"], list(currents), "variable", "value"), block, meters))
    sums = stage(gram.fitted(gram.products(tiles, block, classes=True)))
    tested = F.col("overlap") >= r.min_overlap
    middle = gram.medians(tiles, sums.filter(F.col("n") >= r.min_overlap), block, meters)
    apart = F.abs(F.col("ma") - F.col("mb")) / F.nullif(F.greatest("ma", "mb"), F.lit(0.0))
    mags = middle.groupBy("a", "b").agg(F.avg(apart).alias("m"))
    seen = sums.groupBy("a", "b").agg(F.max("n").cast("long").alias("overlap"), F.avg("r").alias("r")).join(mags, ["a", "b"], "left")
    cover = per.crossJoin(F.broadcast(per.agg(F.max("n").alias("n_ref")))).withColumn("cov", F.col("n") / F.col("n_ref"))
    j = every_pair(per, meters).join(seen, ["a", "b"], "left").na.fill(0, ["overlap"])
    j = j.join(cover.select(F.col("meter_id").alias("a"), F.col("n").alias("na"), F.col("cov").alias("cov_a"), "n_ref"), "a")
    j = j.join(cover.select(F.col("meter_id").alias("b"), F.col("n").alias("nb"), F.col("cov").alias("cov_b")), "b")
    j = j.withColumn("corr", F.when(tested, F.coalesce("r", F.lit(0.0)))).withColumn("mag", F.when(tested, F.coalesce("m", F.lit(1.0))))
    union = (F.col("na") + F.col("nb") - F.col("overlap")) / F.col("n_ref")
    over = F.coalesce((F.col("corr") >= r.corr) & (F.col("mag") <= r.magnitude_tol), F.lit(False))
    inter = (
        (F.col("overlap") / F.greatest(F.least("na", "nb"), F.lit(1)) <= r.interleave_overlap)
        & (F.col("cov_a") < r.partial_coverage) & (F.col("cov_b") < r.partial_coverage) & (union >= r.interleave_union)
    )
    return j.select("a", "b", "overlap", "corr", "mag", union.alias("union_frac"), over.alias("overlapping"), inter.alias("interleaved"))


def main_correlation(wide: DataFrame, currents: Sequence[str], main: int) -> DataFrame:
    """``meter_id, corr_main, cov``: mean correlation of the currents with the main meter over at least so many common steps.

    The main meter itself has 1; only rows with all currents count.
    """
    r = SCOPE
    rows = wide.dropna(subset=list(currents)).select("meter_id", "x", *currents)
    lead = rows.filter(F.col("meter_id") == main).select("x", *[F.col(c).alias(f"lead_{c}") for c in currents])
    flat = lambda c: F.when((F.stddev_pop(c) > 1e-12) & (F.stddev_pop(f"lead_{c}") > 1e-12), safe_corr(c, f"lead_{c}"))
    both = rows.join(lead, "x").groupBy("meter_id").agg(F.count("*").alias("common"), *[flat(c).alias(f"r_{c}") for c in currents])
    rs = F.array_compact(F.array(*[F.col(f"r_{c}") for c in currents]))
    mean = F.when((F.col("common") >= r.min_overlap) & (F.size(rs) > 0), F.aggregate(rs, F.lit(0.0), lambda s, v: s + v) / F.size(rs))
    own = rows.groupBy("meter_id").agg(F.count("*").alias("cov")).join(both, "meter_id", "left")
    return own.select("meter_id", F.when(F.col("meter_id") == main, 1.0).otherwise(mean).alias("corr_main"), "cov")


def duplicate_groups(meters: DataFrame, pairs: DataFrame, main: Sequence[int]) -> DataFrame:
    """Component of each meter and whether it stays: best correlation to the main meter, coverage, lowest id.

    ``meters(meter_id, corr_main, cov)``.
    """
    edges = pairs.filter("overlapping or interleaved").select("a", "b")
    comp = joins.connected_components(meters.select(F.col("meter_id").alias("id")), edges)
    j = meters.join(comp.withColumnRenamed("id", "meter_id"), "meter_id")
    key = F.struct(F.coalesce("corr_main", F.lit(float("-inf"))), "cov", -F.col("meter_id"))
    best = j.groupBy("component").agg(F.max_by("meter_id", key).alias("keeper"), F.count("*").alias("members"))
    keep = (F.col("meter_id") == F.col("keeper")) | F.col("meter_id").isin(list(main))
    return j.join(best, "component").select("meter_id", "component", "members", keep.alias("kept"))
