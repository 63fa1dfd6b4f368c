"""Energy balance of loads and remaining consumption, its sensitivities, uncertainty and cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9

# fixed values: loss scenarios, meter class, tariff
LOSSES = {"S0": 0.0, "S1": 0.01, "S2": 0.02, "S3": 0.05}
METER_CLASS = 0.005
PRICE_USD = 0.20
HOURS_PER_YEAR = 8760.0


def series(scored: DataFrame, rest: DataFrame, main: DataFrame) -> DataFrame:
    """Per model, phase and instant: observed and mean predicted load, remaining and main power."""
    per = scored.groupBy("model", "phase", "x", "output").agg(
        F.first("y").alias("y"), F.avg("y_pred").alias("p")
    )
    sums = per.groupBy("model", "phase", "x").agg(F.sum("y").alias("obs"), F.sum("p").alias("pred"))
    return sums.join(rest, ["phase", "x"]).join(main, ["phase", "x"])


def energies(df: DataFrame, keys: Sequence[str], step_hours: float, loss: Column | float = 0.0, rest: Column | None = None) -> DataFrame:
    """Balance energies under both scenarios: without (R1) and with (R2) the remaining consumption."""
    po = rest if rest is not None else F.col("po")
    loss = F.lit(loss) if isinstance(loss, float) else loss
    mg = (F.col("obs") + po) * (1.0 - loss)
    kwh = step_hours / 1000.0
    sums = {"e_mg": mg, "e_other": po, "e_load_obs": F.col("obs"), "e_load_pred": F.col("pred"), "e_mg_real": F.col("mg_real")}
    g = df.groupBy(*keys).agg(*[(F.sum(c) * kwh).alias(n) for n, c in sums.items()])
    return (
        g.withColumn("r1_obs", F.col("e_load_obs") - F.col("e_mg"))
        .withColumn("r1_pred", F.col("e_load_pred") - F.col("e_mg"))
        .withColumn("r2_obs", F.col("e_load_obs") + F.col("e_other") - F.col("e_mg"))
        .withColumn("r2_pred", F.col("e_load_pred") + F.col("e_other") - F.col("e_mg"))
        .withColumn("erg_bal_pct", F.abs(F.col("r1_pred") - F.col("r1_obs")) / (F.abs("e_mg") + EPS) * 100.0)
    )


def report(e: DataFrame) -> DataFrame:
    """One row per model, scenario and phase, plus the three-phase total."""
    rows = e.select(
        "model", "phase", "e_mg",
        F.inline(F.array(
            F.struct(F.lit("R1").alias("scenario"), F.col("r1_obs").alias("e_dg_obs"), F.col("r1_pred").alias("e_dg_pred")),
            F.struct(F.lit("R2").alias("scenario"), F.col("r2_obs").alias("e_dg_obs"), F.col("r2_pred").alias("e_dg_pred")),
        )),
    )
    total = rows.groupBy("model", "scenario").agg(
        *[F.sum(c).alias(c) for c in ("e_mg", "e_dg_obs", "e_dg_pred")]
    ).withColumn("phase", F.lit("ABC"))
    out = rows.unionByName(total)
    return out.withColumn(
        "erg_bal_pct", F.abs(F.col("e_dg_pred") - F.col("e_dg_obs")) / (F.abs("e_mg") + EPS) * 100.0
    )


def loss_sensitivity(df: DataFrame, step_hours: float, losses: Mapping[str, float] = LOSSES) -> DataFrame:
    """Balance under each loss scenario; the sums are taken once and scaled."""
    arms = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(v).alias("loss")) for s, v in losses.items()])
    base = energies(df, ["model", "phase"], step_hours).select("model", "phase", "e_load_obs", "e_load_pred", "e_other")
    out = base.withColumn("_a", F.explode(arms)).select("*", "_a.scenario", "_a.loss").drop("_a")
    out = out.withColumn("e_mg", (F.col("e_load_obs") + F.col("e_other")) * (1.0 - F.col("loss")))
    return (
        out.withColumn("e_dg_pred_r1", F.col("e_load_pred") - F.col("e_mg"))
        .withColumn("e_dg_pred_r2", F.col("e_load_pred") + F.col("e_other") - F.col("e_mg"))
        .withColumn("erg_bal_pct", F.abs(F.col("e_load_pred") - F.col("e_load_obs")) / (F.abs("e_mg") + EPS) * 100.0)
    )


def component_shares(components: DataFrame) -> DataFrame:
    """Share of each component in the remaining energy of its phase."""
    g = components.groupBy("phase", "meter_id").agg(F.sum("p").alias("e"))
    return g.withColumn("frac", F.col("e") / F.nullif(F.sum("e").over(Window.partitionBy("phase")), F.lit(0.0)))


def structural_sensitivity(df: DataFrame, shares: DataFrame, step_hours: float) -> DataFrame:
    """Change of the R1 balance when one component is taken out by its energy share."""
    base = energies(df, ["model", "phase"], step_hours)
    j = base.join(shares.select("phase", F.col("meter_id").alias("removed"), "frac"), "phase")
    without = F.col("e_load_pred") - (F.col("e_load_obs") + F.col("e_other") * (1.0 - F.col("frac")))
    return j.withColumn("e_dg_r1", without).withColumn("delta", without - F.col("r1_pred")).withColumn(
        "delta_pct", F.col("delta") / (F.abs("e_mg") + EPS) * 100.0
    )


def uncertainty(scored: DataFrame, shifted: DataFrame, step_hours: float) -> DataFrame:
    """Budget per model and phase, and for the three phases summed inside each seed.

    ``shifted`` holds per phase and instant the observed sum ``o`` and its half-step shifts ``oa``, ``ob``.
    """
    kwh = step_hours / 1000.0
    pred = scored.groupBy("model", "seed", "phase", "x").agg(F.sum("y_pred").alias("p"))
    ends = pred.groupBy("model").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    rows = pred.join(F.broadcast(ends), "model").filter("x > _lo and x < _hi").join(shifted, ["phase", "x"])
    per = rows.groupBy("model", "seed", "phase").agg(
        (F.sum("o") * kwh).alias("e_obs"),
        (F.sum(F.col("p") - F.col("o")) * kwh).alias("e0"),
        (F.sum(F.col("o") - F.col("oa")) * kwh).alias("dp"),
        (F.sum(F.col("o") - F.col("ob")) * kwh).alias("dm"),
    ).withColumn("e_obs", F.abs("e_obs"))
    total = per.groupBy("model", "seed").agg(*[F.sum(c).alias(c) for c in ("e_obs", "e0", "dp", "dm")])
    both = per.unionByName(total.withColumn("phase", F.lit("ABC")))
    out = both.groupBy("model", "phase").agg(
        (F.lit(METER_CLASS) * F.avg("e_obs")).alias("u_met"),
        F.stddev_samp("e0").alias("u_seed"),
        F.avg(F.sqrt((F.col("dm") ** 2 + F.col("dp") ** 2) / 2.0)).alias("u_sync"),
        F.avg("e0").alias("e_res"),
    )
    return out.withColumn("u_total", F.sqrt(F.col("u_met") ** 2 + F.col("u_seed") ** 2 + F.col("u_sync") ** 2))


def cost(metrics: DataFrame, hours: float, price: float = PRICE_USD) -> DataFrame:
    """Cost of true and predicted energy, of the error, and its yearly value, per model and seed."""
    g = metrics.groupBy("model", "seed").agg(
        F.sum("e_true").alias("e_true"), F.sum("e_pred").alias("e_pred"),
        F.sum(F.abs(F.col("e_true") - F.col("e_pred"))).alias("e_error"),
    )
    true, pred = F.col("e_true") * price, F.col("e_pred") * price
    return g.select(
        "model", "seed", true.alias("c_true"), pred.alias("c_pred"), (F.col("e_error") * price).alias("c_error"),
        (F.abs(true - pred) / (F.abs(true) + EPS) * 100.0).alias("delta_pct"),
        (F.col("e_error") * price * (HOURS_PER_YEAR / hours)).alias("c_yearly"),
    )


def cost_by_type(e: DataFrame, hours: float, price: float = PRICE_USD) -> DataFrame:
    kinds = {
        "observed": F.sum("e_load_obs"), "predicted": F.sum("e_load_pred"), "balance": F.sum(F.abs("r1_obs")),
        "inferred": F.sum("e_other"), "main_meter": F.sum("e_mg"),
    }
    g = e.groupBy("model").agg(*[c.alias(n) for n, c in kinds.items()])
    return g.unpivot(["model"], list(kinds), "kind", "e_kwh").withColumn("c_usd", F.col("e_kwh") * price).withColumn(
        "c_yearly", F.col("e_kwh") * price * (HOURS_PER_YEAR / hours)
    )


def cost_uncertainty(budget: DataFrame, model: str, price: float = PRICE_USD) -> DataFrame:
    """Cost of the phase uncertainties of one model and their quadrature."""
    u = budget.filter((F.col("model") == model) & (F.col("phase") != "ABC")).select("phase", F.col("u_total").alias("u_kwh"))
    total = u.agg(F.sqrt(F.sum(F.col("u_kwh") * F.col("u_kwh"))).alias("u_kwh")).select(F.lit("total").alias("phase"), "u_kwh")
    return u.unionByName(total).withColumn("u_usd", F.col("u_kwh") * price)
