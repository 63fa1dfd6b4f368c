"""Energy preservation, channel roles, scenario matrices, features and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions import names, scalars
from voltloom.operators import seq

# fixed values: gates of the energy preservation check, in percent and kWh
DEAD_PCT, ALERT_PCT, BLOCK_PCT, NEAR_ZERO_KWH = 99.0, 1.0, 5.0, 1.0


def energy_preservation(before: DataFrame, after: DataFrame, step_hours: float) -> DataFrame:
    """Observed energy before and after filling, per channel of ``(meter_id, variable, x, value)``."""
    keys = ["meter_id", "variable", "x"]
    j = before.withColumnRenamed("value", "pre").join(after.withColumnRenamed("value", "post"), keys, "outer")
    kwh = step_hours / 1000.0
    pre, post = F.col("pre"), F.col("post")
    energy = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) * kwh
    g = j.groupBy("meter_id", "variable").agg(
        F.count("*").alias("n"), F.count("pre").alias("n_obs"),
        F.count_if(pre.isNull() & post.isNotNull()).alias("n_new"), F.count_if(post.isNull()).alias("n_left"),
        energy(pre).alias("e_pre"), energy(F.when(pre.isNotNull(), post)).alias("e_kept"), energy(post).alias("e_total"),
    )
    dead = (F.col("n") - F.col("n_obs")) * 100.0 / F.col("n") >= DEAD_PCT
    small = F.abs("e_pre") < NEAR_ZERO_KWH
    g = g.withColumn("change_pct", scalars.rel_change_pct("e_pre", "e_kept")).withColumn(
        "gain_pct", scalars.rel_change_pct("e_pre", "e_total")
    )
    return (
        g.withColumn("dead", dead)
        .withColumn("dead_filled", F.col("dead") & (F.col("n_new") > 0))
        .withColumn("alert", ~small & (F.col("change_pct") > ALERT_PCT))
        .withColumn("blocked", ~small & (F.col("change_pct") > BLOCK_PCT))
    )


def channel_roles(energy: DataFrame, dim: DataFrame) -> DataFrame:
    """Final role of each channel; ``dim`` holds the designed role of the meters in scope."""
    j = energy.join(dim.select("meter_id", "role"), "meter_id", "left")
    role = (
        F.when(F.col("role").isNull(), "outside_scope").when(F.col("dead"), "dead").when(F.col("blocked"), "blocked")
        .when(F.col("role") == "m_g_input", "M_G_input").when(F.col("role") == "modeled_loads", "Gamma_i")
        .when(F.col("role") == "p_other_components", "P_other").otherwise("excluded_unassigned")
    )
    why = F.concat_ws(
        ";", F.when(F.col("role").isNull(), "not_in_scope"), F.when(F.col("dead"), "dead_channel"),
        F.when(F.col("dead_filled"), "dead_was_filled"), F.when(F.col("blocked"), "energy_not_preserved"),
    )
    return j.withColumn("role_final", role).withColumn("reason", why)


def mask_channels(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Blank the power cells of dead or blocked channels."""
    bad = channels.filter("dead or blocked").select("meter_id", "variable", F.lit(True).alias("_bad"))
    j = samples.join(bad, ["meter_id", "variable"], "left")
    return j.withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")


def scenario_long(samples: DataFrame, dim: DataFrame) -> DataFrame:
    """Active power as ``(x, output, p)`` named by the role of its meter; several rest meters add up."""
    j = samples.filter(names.family_of("variable") == "p").join(dim.select("meter_id", "role", "gamma_id"), "meter_id")
    phase = F.upper(names.phase_of("variable"))
    stem = (
        F.when(F.col("role") == "m_g_input", "M_G").when(F.col("role") == "p_other_components", "P_other")
        .when(F.col("role") == "modeled_loads", F.concat(F.lit("G"), F.col("gamma_id").cast("string")))
    )
    rows = j.withColumn("output", F.concat_ws("_", stem, phase)).filter(stem.isNotNull())
    return rows.groupBy("x", "output").agg(F.sum("value").alias("p"))


def scenario_matrix(long: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """One row per instant and one column per output; the column list is given, so one pass suffices."""
    return long.groupBy("x").pivot("output", list(outputs)).agg(F.first("p"))


def relative_steps(stages: DataFrame) -> DataFrame:
    """Energies by stage side by side with their relative changes."""
    wide = stages.groupBy("meter_id", "phase").pivot("stage", ["raw", "gridded", "clean", "filled"]).agg(F.first("kwh"))
    return (
        wide.withColumn("grid_vs_raw", scalars.rel_change_pct("raw", "gridded", signed=True))
        .withColumn("clean_vs_grid", scalars.rel_change_pct("gridded", "clean", signed=True))
        .withColumn("filled_vs_clean", scalars.rel_change_pct("clean", "filled", signed=True))
        .withColumn("alert", F.abs("clean_vs_grid") > 5.0)
    )


def target_validity(conf: DataFrame) -> DataFrame:
    """Validity of a cell under the three scopes."""
    return conf.withColumn("obs", F.col("code") == 0).withColumn("supported", F.col("code").isin(0, 1, 2)).withColumn(
        "complete", F.lit(True)
    )


def time_folds(mask: DataFrame, total: int, folds: int = 5, min_train: int = 50, min_valid: int = 30) -> DataFrame:
    """Expanding folds on the grid; a masked row never moves the borders, only the counts.

    ``mask(output, x, ok)`` with ``x`` in ``0..total-1``. Only folds with enough rows on both sides are kept.
    """
    size = total // (folds + 1)
    first = total - folds * size
    f = mask.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.lit(first) + F.col("fold") * size
    train = F.col("ok") & (F.col("x") < start)
    valid = F.col("ok") & (F.col("x") >= start) & (F.col("x") < start + size)
    g = f.groupBy("output", "fold").agg(F.count_if(train).alias("n_train"), F.count_if(valid).alias("n_valid"))
    return g.filter((F.col("n_train") >= min_train) & (F.col("n_valid") >= min_valid))


def one_se_rule(scores: DataFrame) -> DataFrame:
    """``(set, n_features, seed, nae)``: sets within one standard error of the best, the smallest marked."""
    g = scores.groupBy("set", "n_features").agg(
        F.avg("nae").alias("mean_nae"), (F.stddev_samp("nae") / F.sqrt(F.count("*"))).alias("se")
    )
    best = g.agg(F.min_by(F.col("mean_nae") + F.col("se"), F.struct("mean_nae", "set")).alias("_limit"))
    j = g.crossJoin(F.broadcast(best)).withColumn("within", F.col("mean_nae") <= F.col("_limit")).drop("_limit")
    smallest = F.min(F.when(F.col("within"), F.struct("n_features", "set"))).over(Window.partitionBy())
    return j.withColumn("chosen", F.col("within") & (F.col("set") == smallest["set"]))


def split_windows(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], train: Column, split: Column, width: int, block: int
) -> DataFrame:
    """Scaled windows that never cross a split border; the scale of a series is fitted on its training rows.

    ``rows(keys, x, *columns)`` are dense series.
    """
    fit = rows.filter(train).groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    width_of = lambda c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), F.lit(1.0)).otherwise(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    scaled = rows.join(fit, list(keys)).select(*keys, "x", split.alias("split"), *[((F.col(c) - F.col(f"_lo_{c}")) / width_of(c)).alias(c) for c in columns])
    return seq.windows(scaled, [*keys, "split"], list(columns), width, block=block)
