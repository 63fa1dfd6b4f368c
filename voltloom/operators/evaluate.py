"""Scores of prediction tables: normalised errors, energies, support, ensembles, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
ACTIVE_KWH = 1.0  # fixed value: an output below this energy is not active


def abs_error() -> Column:
    return F.abs(F.col("y_pred") - F.col("y"))


def nae(strict: bool = False) -> Column:
    """Aggregate: absolute error over absolute truth in percent; ``strict`` yields NULL on zero truth."""
    truth = F.sum(F.abs("y"))
    if strict:
        return F.sum(abs_error()) / F.nullif(truth, F.lit(0.0)) * 100.0
    return F.sum(abs_error()) / (truth + EPS) * 100.0


def score_rows(aligned: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions beside the truth of their instant."""
    return aligned.join(truth.select("output", "gamma", "phase", "x", "y"), ["output", "x"]).select(
        "model", "seed", "output", "gamma", "phase", "x", "y", "y_pred"
    )


def load_metrics(scored: DataFrame, step_hours: float) -> DataFrame:
    """Per model, seed and output: errors, energies, share in the energy error, activity."""
    kwh = step_hours / 1000.0
    per = scored.groupBy("model", "seed", "output", "gamma", "phase").agg(
        nae().alias("nae_pct"),
        F.avg(abs_error()).alias("mae_w"),
        (F.sum("y") * kwh).alias("e_true"),
        (F.sum("y_pred") * kwh).alias("e_pred"),
    )
    run = Window.partitionBy("model", "seed")  # one row per output
    delta = F.col("e_true") - F.col("e_pred")
    return (
        per.withColumn("delta", delta)
        .withColumn("contrib_pct", F.abs(delta) / (F.sum(F.abs("e_true")).over(run) + EPS) * 100.0)
        .withColumn("active", F.abs("e_true") >= ACTIVE_KWH)
    )


def system_error(metrics: DataFrame) -> DataFrame:
    """Per model and seed: mean error of the active outputs (all, if none is active) and the error of the energy sum."""
    g = metrics.groupBy("model", "seed").agg(
        F.coalesce(F.avg(F.when(F.col("active"), F.col("nae_pct"))), F.avg("nae_pct")).alias("nae_mean"),
        F.sum("e_true").alias("e_true"),
        F.sum("e_pred").alias("e_pred"),
    )
    erg = F.abs(F.col("e_pred") - F.col("e_true")) / (F.abs("e_true") + EPS) * 100.0
    return g.withColumn("erg_pct", erg)


def over_seeds(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def seed_envelope(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "output", "x").agg(
        F.min("y_pred").alias("lo"), F.max("y_pred").alias("hi"),
        F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("sd"),
    )


def observed_only(scored: DataFrame, observed: DataFrame, min_points: int = 30) -> DataFrame:
    """Errors on originally observed targets only, per model, seed and output."""
    j = scored.join(observed.select("output", "x", F.lit(True).alias("_obs")), ["output", "x"], "left")
    obs = F.col("_obs").isNotNull()
    e, a = abs_error(), F.abs("y")
    return j.groupBy("model", "seed", "output").agg(
        F.count("*").alias("n"),
        F.count_if(obs).alias("n_obs"),
        nae().alias("nae_full"),
        F.when(
            F.count_if(obs) >= min_points,
            F.sum(F.when(obs, e)) / (F.sum(F.when(obs, a)) + EPS) * 100.0,
        ).alias("nae_obs"),
    )


def common_support(scored: DataFrame) -> DataFrame:
    """Rows on the instants every model covers (one row of borders, joined to all)."""
    spans = scored.groupBy("model").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    border = spans.agg(F.max("a").alias("_lo"), F.min("b").alias("_hi"))
    return scored.join(F.broadcast(border), F.col("x").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def best_by_output(validation: DataFrame) -> DataFrame:
    """Per output the model of lowest validation error; ties go to the first name."""
    return validation.groupBy("output").agg(F.min_by("model", F.struct("nae_pct", "model")).alias("model"))


def ensemble(scored: DataFrame, choice: DataFrame, name: str) -> DataFrame:
    """Predictions of the chosen model of each output as a model of its own."""
    return scored.join(F.broadcast(choice), ["output", "model"]).withColumn("model", F.lit(name))


def mean_over_seeds(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "window_idx", "output").agg(F.avg("y_pred").alias("y_pred"))
