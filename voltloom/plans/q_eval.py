"""Scores, balances, uncertainty, cost, tests and result tables of the prediction models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.operators import balance, evaluate, joins, ranks, seq, statistics
from voltloom.plans.fixture_sql import R, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources import fixtures
from voltloom.sources.fixtures import BLOCK


def shown(df, keys, values, digits=4):
    return df.select(*keys, *[fixed(v, digits).alias(v) for v in values])


def _cols(values, digits=4):
    return ", ".join(f"{R(v, digits)} as {v}" for v in values)


@query("align_windows", with_tables(f"select model, x, count(*) as n, {R('sum(y_pred)', 2)} as total from scored group by 1, 2", "scored"))
def align_windows(t: Inputs):
    a = joins.align_windows(t.predictions, dict(fixtures.MODELS))
    return a.groupBy("model", "x").agg(F.count("*").alias("n"), fixed(F.sum("y_pred"), 2).alias("total"))


@query(
    "nae_pct",
    with_tables(
        f"""select output, {R('sum(abs(y_pred - y)) / (sum(abs(y)) + 1e-9::double) * 100')} as nae,
        {R('sum(abs(y_pred - y)) / nullif(sum(abs(y)), 0) * 100')} as nae_strict from scored group by 1""",
        "scored",
    ),
)
def nae_pct(t: Inputs):
    g = t.scored.groupBy("output").agg(evaluate.nae().alias("nae"), evaluate.nae(strict=True).alias("nae_strict"))
    return shown(g, ["output"], ["nae", "nae_strict"])


_LM = ["nae_pct", "mae_w", "e_true", "e_pred", "delta", "contrib_pct"]


@query("load_metrics", with_tables(f"select model, seed, output, active, {_cols(_LM)} from load_metrics", "load_metrics"))
def load_metrics(t: Inputs):
    return shown(t.load_metrics, ["model", "seed", "output", "active"], _LM)


@query("system_erg", with_tables(f"select model, seed, {_cols(['nae_mean', 'erg_pct'])} from system", "system"))
def system_erg(t: Inputs):
    return shown(evaluate.system_error(t.load_metrics), ["model", "seed"], ["nae_mean", "erg_pct"])


@query(
    "energy_by_load",
    with_tables(
        f"select model, seed, gamma, {R('sum(e_true)')} as e_true, {R('sum(e_pred)')} as e_pred,"
        f" {R('abs(sum(e_true) - sum(e_pred)) / (abs(sum(e_true)) + 1e-9::double) * 100')} as erg from load_metrics group by 1, 2, 3",
        "load_metrics",
    ),
)
def energy_by_load(t: Inputs):
    g = t.load_metrics.groupBy("model", "seed", "gamma").agg(F.sum("e_true").alias("e_true"), F.sum("e_pred").alias("e_pred"))
    g = g.withColumn("erg", F.abs(F.col("e_true") - F.col("e_pred")) / (F.abs("e_true") + 1e-9) * 100.0)
    return shown(g, ["model", "seed", "gamma"], ["e_true", "e_pred", "erg"])


@query(
    "energy_by_output",
    with_tables(f"select output, {R('avg(e_true)')} as e_true, {R('avg(e_pred)')} as e_pred, {R('avg(contrib_pct)')} as contrib from load_metrics group by 1", "load_metrics"),
)
def energy_by_output(t: Inputs):
    g = t.load_metrics.groupBy("output").agg(F.avg("e_true").alias("e_true"), F.avg("e_pred").alias("e_pred"), F.avg("contrib_pct").alias("contrib"))
    return shown(g, ["output"], ["e_true", "e_pred", "contrib"])


@query(
    "seed_dispersion",
    with_tables(
        f"select model, output, active, {R('avg(nae_pct)')} as nae_pct_mean, {R('stddev_samp(nae_pct)')} as nae_pct_sd,"
        f" {R('avg(contrib_pct)')} as contrib_pct_mean, {R('stddev_samp(contrib_pct)')} as contrib_pct_sd from load_metrics group by 1, 2, 3",
        "load_metrics",
    ),
)
def seed_dispersion(t: Inputs):
    g = evaluate.over_seeds(t.load_metrics, ["model", "output", "active"], ["nae_pct", "contrib_pct"])
    return shown(g, ["model", "output", "active"], ["nae_pct_mean", "nae_pct_sd", "contrib_pct_mean", "contrib_pct_sd"])


@query(
    "seed_envelope",
    with_tables(
        f"select model, output, x, {R('min(y_pred)')} as lo, {R('max(y_pred)')} as hi, {R('avg(y_pred)')} as mean, {R('stddev_pop(y_pred)', 3)} as sd from scored group by 1, 2, 3",
        "scored",
    ),
)
def seed_envelope(t: Inputs):
    e = evaluate.seed_envelope(t.scored)
    return e.select("model", "output", "x", fixed("lo").alias("lo"), fixed("hi").alias("hi"), fixed("mean").alias("mean"), fixed("sd", 3).alias("sd"))


_OBS_CTE = "select d.output, d.x from (select t.output, t.x, c.code from truth t join conf c on c.meter_id = t.meter_id and c.variable = t.variable and c.x = t.x) d where code = 0"


def observed(t: Inputs):
    j = t.truth.select("output", "meter_id", "variable", "x").join(t.conf, ["meter_id", "variable", "x"])
    return j.filter("code = 0").select("output", "x")


@query(
    "observed_only_nae",
    with_tables(
        f"""with o as ({_OBS_CTE}), j as (select s.*, o.x is not null as ob from scored s left join o on o.output = s.output and o.x = s.x)
        select model, seed, output, count(*) as n, count_if(ob) as n_obs, {R('sum(abs(y_pred - y)) / (sum(abs(y)) + 1e-9::double) * 100')} as nae_full,
        case when count_if(ob) >= 30 then {R('sum(abs(y_pred - y)) filter (ob) / (sum(abs(y)) filter (ob) + 1e-9::double) * 100')} end as nae_obs from j group by 1, 2, 3""",
        "scored", "truth", "conf",
    ),
)
def observed_only_nae(t: Inputs):
    g = evaluate.observed_only(t.scored, observed(t))
    return shown(g, ["model", "seed", "output", "n", "n_obs"], ["nae_full", "nae_obs"])


_SUPPORT = "select s.* from scored s, (select max(a) as lo, min(b) as hi from (select min(x) as a, max(x) as b from scored group by model)) k where x between lo and hi"


@query("common_support", with_tables("select max(a) as lo, min(b) as hi from (select min(x) as a, max(x) as b from scored group by model)", "scored"))
def common_support(t: Inputs):
    return evaluate.common_support(t.scored).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


@query(
    "common_support_nae",
    with_tables(
        f"with c as ({_SUPPORT}) select model, output, count(*) as n, {R('sum(abs(y_pred - y)) / (sum(abs(y)) + 1e-9::double) * 100')} as nae from c group by 1, 2",
        "scored",
    ),
)
def common_support_nae(t: Inputs):
    g = evaluate.common_support(t.scored).groupBy("model", "output").agg(F.count("*").alias("n"), evaluate.nae().alias("nae"))
    return shown(g, ["model", "output", "n"], ["nae"])


@query(
    "null_predictor",
    with_tables(
        f"""with o as ({_OBS_CTE}), m as (select t.output, quantile_cont(t.y, 0.5) as c from truth t join o on o.output = t.output and o.x = t.x where t.x < (select train_end from span) group by 1)
        select t.output, {R('any_value(c)')} as constant, {R('sum(abs(c - y)) / (sum(abs(y)) + 1e-9::double) * 100')} as nae
        from truth t join m on m.output = t.output where t.x >= (select valid_end from span) group by 1""",
        "truth", "conf", "span",
    ),
)
def null_predictor(t: Inputs):
    return shown(constant_error(t), ["output"], ["constant", "nae"])


def constant_error(t: Inputs):
    """Error of each output's training median on the test steps."""
    train = t.truth.filter(F.col("x") < t.train_end).join(observed(t), ["output", "x"])
    const = ranks.quantiles(train, ["output"], "y", {"y_pred": 0.5})
    test = t.truth.filter(F.col("x") >= t.valid_end).join(const, "output")
    return test.groupBy("output").agg(F.first("y_pred").alias("constant"), evaluate.nae().alias("nae"))


@query(
    "per_output_matrix",
    with_tables(
        f"""with o as ({_OBS_CTE}), c as (select t.output, quantile_cont(t.y, 0.5) as c from truth t join o on o.output = t.output and o.x = t.x where t.x < (select train_end from span) group by 1),
        k as (select t.output, sum(abs(c - y)) / (sum(abs(y)) + 1e-9::double) * 100 as constant from truth t join c on c.output = t.output where t.x >= (select valid_end from span) group by 1)
        select m.output, {', '.join(f"{R(f'avg(nae_pct) filter (model = $${m}$$)')} as {m}" for m, _ in fixtures.MODELS)}, {R('any_value(constant)')} as constant
        from load_metrics m left join k on k.output = m.output group by 1""",
        "load_metrics", "truth", "conf", "span",
    ),
)
def per_output_matrix(t: Inputs):
    models = [m for m, _ in fixtures.MODELS]
    p = t.load_metrics.groupBy("output").pivot("model", models).agg(F.avg("nae_pct"))
    return shown(p.join(constant_error(t).select("output", F.col("nae").alias("constant")), "output", "left"), ["output"], [*models, "constant"])


@query(
    "leakage_control",
    with_tables(
        """with inp as (select x, bool_and(code = 0) as ok from conf where meter_id = 1 group by 1),
        tgt as (select x, bool_and(code = 0) as ok from conf where meter_id in (3, 5, 6, 7) and variable in ('p_a', 'p_b', 'p_c') group by 1),
        w as (select x as window_idx, count(*) over v as n, bool_and(ok) over v as inputs_ok from inp window v as (order by x rows between current row and 11 following))
        select window_idx, inputs_ok and t.ok as valid from w join tgt t on t.x = w.window_idx + 6 where n = 12""",
        "conf",
    ),
)
def leakage_control(t: Inputs):
    clean = F.bool_and(F.col("code") == 0)
    inp = t.conf.filter("meter_id = 1").groupBy("x").agg(clean.alias("ok"))
    tgt = t.conf.filter("meter_id in (3, 5, 6, 7) and variable in ('p_a', 'p_b', 'p_c')").groupBy("x").agg(clean.alias("target_ok"))
    cols = {
        "inputs_ok": lambda w: F.min("ok").over(w.rowsBetween(0, 11)),
        "n": lambda w: F.count("*").over(w.rowsBetween(0, 11)),
    }
    win = seq.framed(inp, [], cols, 0, 11, block=BLOCK).filter("n = 12")
    j = win.select(F.col("x").alias("window_idx"), "inputs_ok", (F.col("x") + 6).alias("x")).join(tgt, "x")
    return j.select("window_idx", (F.col("inputs_ok") & F.col("target_ok")).alias("valid"))


@query(
    "confidence_by_split",
    with_tables(
        "select coalesce(split, 'all') as split, code, count(*) as n from (select code, case when x < (select train_end from span) then 'train' when x < (select valid_end from span) then 'val' else 'test' end as split from conf) group by grouping sets ((split, code), (code))",
        "conf", "span",
    ),
)
def confidence_by_split(t: Inputs):
    return (
        t.conf.withColumn("s", t.split()).rollup("code", "s").agg(F.count("*").alias("n"), F.grouping("s").alias("g"), F.grouping("code").alias("h"))
        .filter("h = 0").select(F.when(F.col("g") == 1, "all").otherwise(F.col("s")).alias("split"), "code", "n")
    )


_VAL = f"select output, model, {R('avg(nae_pct)', 8)} as nae_pct from load_metrics group by 1, 2"


def validation(t: Inputs):
    return t.load_metrics.groupBy("output", "model").agg(fixed(F.avg("nae_pct"), 8).alias("nae_pct"))


@query(
    "hard_outputs",
    with_tables(f"with v as ({_VAL}) select output, model, nae_pct, rn from (select *, row_number() over (partition by model order by nae_pct desc nulls last, output) as rn from v) where rn <= 3", "load_metrics"),
)
def hard_outputs(t: Inputs):
    w = Window.partitionBy("model").orderBy(F.desc_nulls_last("nae_pct"), "output")
    return validation(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 3")


@query(
    "pick_by_output",
    with_tables(f"with v as ({_VAL}) select output, model from (select *, row_number() over (partition by output order by nae_pct, model) as rn from v) where rn = 1", "load_metrics"),
)
def pick_by_output(t: Inputs):
    return evaluate.best_by_output(validation(t))


@query(
    "ensemble_select",
    with_tables(
        f"""with v as ({_VAL}), b as (select output, model from (select *, row_number() over (partition by output order by nae_pct, model) as rn from v) where rn = 1)
        select s.seed, s.output, {R('sum(abs(y_pred - y)) / (sum(abs(y)) + 1e-9::double) * 100')} as nae from scored s join b on b.output = s.output and b.model = s.model group by 1, 2""",
        "load_metrics", "scored",
    ),
)
def ensemble_select(t: Inputs):
    e = evaluate.ensemble(t.scored, evaluate.best_by_output(validation(t)), "ensemble")
    return shown(e.groupBy("seed", "output").agg(evaluate.nae().alias("nae")), ["seed", "output"], ["nae"])


@query(
    "config_comparison",
    with_tables(
        f"""with p as (select a.model, a.seed, a.nae_mean as nae_a, b.nae_mean as nae_b, b.nae_mean - a.nae_mean as delta from system a join system b on a.seed = b.seed and b.model = a.model || 't'),
        m as (select model, avg(nae_a) as mean_a, avg(nae_b) as mean_b, stddev_samp(delta) as sd_delta, avg(delta) as mean_delta, row_number() over (order by avg(delta), model) as rank from p group by 1)
        select p.model, seed, rank, {_cols(['nae_a', 'nae_b', 'delta', 'mean_a', 'mean_b', 'mean_delta', 'sd_delta'])} from p join m on m.model = p.model""",
        "system",
    ),
)
def config_comparison(t: Inputs):
    """Default beside tuned configurations by seed; the one that gains most has rank 1."""
    s = evaluate.system_error(t.load_metrics).select("model", "seed", "nae_mean")
    tuned = s.filter(F.col("model").endswith("t")).select(F.expr("left(model, length(model) - 1)").alias("model"), "seed", F.col("nae_mean").alias("nae_b"))
    p = s.withColumnRenamed("nae_mean", "nae_a").join(tuned, ["model", "seed"]).withColumn("delta", F.col("nae_b") - F.col("nae_a"))
    m = p.groupBy("model").agg(
        F.avg("nae_a").alias("mean_a"), F.avg("nae_b").alias("mean_b"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta")
    ).withColumn("rank", F.row_number().over(Window.orderBy("mean_delta", "model")).cast("long"))
    return shown(p.join(m, "model"), ["model", "seed", "rank"], ["nae_a", "nae_b", "delta", "mean_a", "mean_b", "mean_delta", "sd_delta"])


@query("mean_over_seeds", with_tables(f"select model, window_idx, output, {R('avg(y_pred)')} as y_pred from predictions group by 1, 2, 3", "predictions"))
def mean_over_seeds(t: Inputs):
    return shown(evaluate.mean_over_seeds(t.predictions), ["model", "window_idx", "output"], ["y_pred"])


@query(
    "training_curves",
    with_tables(f"select model, epoch, {R('avg(loss)', 2)} as loss, {R('avg(val_loss)', 2)} as val_loss from history group by 1, 2", "history"),
)
def training_curves(t: Inputs):
    g = t.history.groupBy("model", "epoch").agg(F.avg("loss").alias("loss"), F.avg("val_loss").alias("val_loss"))
    return shown(g, ["model", "epoch"], ["loss", "val_loss"], 2)


@query(
    "tag_sensitivity",
    with_tables("select case when family = 'primary' then model else model || '*' end as shown, family as grp, n from models join (select model, count(*) as n from predictions group by 1) using (model)", "predictions", "models"),
)
def tag_sensitivity(t: Inputs):
    extra = ~primary()
    return t.predictions.groupBy("model").agg(F.count("*").alias("n")).select(
        F.when(extra, F.concat("model", F.lit("*"))).otherwise(F.col("model")).alias("shown"),
        F.when(extra, "sensitivity").otherwise("primary").alias("grp"), "n",
    )


# ---- balance ---------------------------------------------------------------------------------


@query("build_balance_series", with_tables(f"select model, phase, x, {_cols(['obs', 'pred', 'po', 'mg_real'], 3)} from balance", "balance"))
def build_balance_series(t: Inputs):
    return shown(t.balance, ["model", "phase", "x"], ["obs", "pred", "po", "mg_real"], 3)


@query(
    "balance_energy",
    with_tables(
        f"select model, phase, {R('mg')} as e_mg, {R('ot')} as e_other, {R('lo')} as e_load_obs, {R('lp')} as e_load_pred, {R('mgr')} as e_mg_real, {R('r1_obs')} as r1_obs, {R('r1_pred')} as r1_pred, {R('r2_pred')} as r2_pred, {R('abs(r1_pred - r1_obs) / (abs(mg) + 1e-9::double) * 100')} as erg_bal_pct from energies",
        "energies",
    ),
)
def balance_energy(t: Inputs):
    e = balance.energies(t.balance, ["model", "phase"], 1.0)
    return shown(e, ["model", "phase"], ["e_mg", "e_other", "e_load_obs", "e_load_pred", "e_mg_real", "r1_obs", "r1_pred", "r2_pred", "erg_bal_pct"])


@query(
    "balance_report",
    with_tables(
        f"""with r as (select model, 'R1' as scenario, phase, mg, r1_obs as o, r1_pred as p from energies union all select model, 'R2', phase, mg, r2_obs, r2_pred from energies),
        g as (select model, scenario, coalesce(phase, 'ABC') as phase, sum(mg) as mg, sum(o) as o, sum(p) as p from r group by grouping sets ((model, scenario, phase), (model, scenario)))
        select model, scenario, phase, {R('mg')} as e_mg, {R('p')} as e_dg_pred, {R('abs(p - o) / (abs(mg) + 1e-9::double) * 100')} as erg_bal_pct from g""",
        "energies",
    ),
)
def balance_report(t: Inputs):
    r = balance.report(balance.energies(t.balance, ["model", "phase"], 1.0))
    return shown(r, ["model", "scenario", "phase"], ["e_mg", "e_dg_pred", "erg_bal_pct"])


@query(
    "loss_sensitivity",
    with_tables(
        f"""select model, phase, scenario, loss, {R('(lo + ot) * (1 - loss)')} as e_mg, {R('lp - (lo + ot) * (1 - loss)')} as e_dg_pred_r1, {R('lp + ot - (lo + ot) * (1 - loss)')} as e_dg_pred_r2,
        {R('abs(lp - lo) / (abs((lo + ot) * (1 - loss)) + 1e-9::double) * 100')} as erg_bal_pct from energies,
        (values ('S0', 0.0::double), ('S1', 0.01::double), ('S2', 0.02::double), ('S3', 0.05::double)) l(scenario, loss)""",
        "energies",
    ),
)
def loss_sensitivity(t: Inputs):
    s = balance.loss_sensitivity(t.balance, 1.0)
    return shown(s, ["model", "phase", "scenario", "loss"], ["e_mg", "e_dg_pred_r1", "e_dg_pred_r2", "erg_bal_pct"])


_SHARES = "select phase, meter_id, sum(p) / nullif(sum(sum(p)) over (partition by phase), 0) as frac from parts where meter_id in (2, 4) group by 1, 2"


@query(
    "structural_sensitivity",
    with_tables(
        f"with c as ({_SHARES}) select model, e.phase, meter_id as removed, {R('frac', 6)} as frac, {R('lp - (lo + ot * (1 - frac))')} as e_dg_r1, {R('lp - (lo + ot * (1 - frac)) - r1_pred')} as delta, {R('(lp - (lo + ot * (1 - frac)) - r1_pred) / (abs(mg) + 1e-9::double) * 100')} as delta_pct from energies e join c on c.phase = e.phase",
        "energies", "parts",
    ),
)
def structural_sensitivity(t: Inputs):
    shares = balance.component_shares(fixtures.component_power(t.dense, fixtures.COMPONENTS))
    s = balance.structural_sensitivity(t.balance, shares, 1.0)
    return s.select("model", "phase", "removed", fixed("frac", 6).alias("frac"), *[fixed(c).alias(c) for c in ("e_dg_r1", "delta", "delta_pct")])


def budget(t: Inputs):
    obs = t.truth.groupBy("phase", "x").agg(F.sum("y").alias("o"))
    half = {
        "oa": lambda w: 0.5 * (F.col("o") + F.lead("o").over(w)),
        "ob": lambda w: 0.5 * (F.lag("o").over(w) + F.col("o")),
    }
    shifted = seq.framed(obs, ["phase"], half, 1, 1, block=BLOCK)
    return t.kept("budget", lambda: balance.uncertainty(t.scored, shifted, 1.0))


_U = ["u_met", "u_seed", "u_sync", "e_res", "u_total"]


@query("uncertainty_budget", with_tables(f"select model, phase, {_cols(_U)} from budget", "budget"))
def uncertainty_budget(t: Inputs):
    return shown(budget(t), ["model", "phase"], _U)


@query(
    "interval",
    with_tables(f"select e.model, e.phase, {R('r2_pred')} as e_dg_pred, {R('r2_pred - 2 * u_total')} as low, {R('r2_pred + 2 * u_total')} as high from energies e join budget b on b.model = e.model and b.phase = e.phase", "energies", "budget"),
)
def interval(t: Inputs):
    e = balance.energies(t.balance, ["model", "phase"], 1.0)
    j = e.join(budget(t), ["model", "phase"])
    return j.select("model", "phase", fixed("r2_pred").alias("e_dg_pred"), fixed(F.col("r2_pred") - 2 * F.col("u_total")).alias("low"), fixed(F.col("r2_pred") + 2 * F.col("u_total")).alias("high"))


@query("residual_by_model", with_tables(f"select model, {R('e_res')} as e_r, {R('2 * u_total')} as u from budget where phase = 'ABC'", "budget"))
def residual_by_model(t: Inputs):
    return budget(t).filter("phase = 'ABC'").select("model", fixed("e_res").alias("e_r"), fixed(2 * F.col("u_total")).alias("u"))


@query(
    "pother_completeness",
    with_tables(
        f"""with c as (select x, count(distinct meter_id) as c, sum(p_a + p_b + p_c) as p from gridded where meter_id in (2, 3, 4, 5) and i_an > 0.5 group by 1),
        m as (select x, p_a + p_b + p_c as mg from gridded where meter_id = 1), k as (select unnest(range(1, 5)) as k)
        select k, count(*) as n, {R('sum(p) / 1000.0::double')} as e_parts, {R('sum(mg) / 1000.0::double')} as e_main, {R('sum(p) / nullif(sum(mg), 0) * 100')} as pct_main
        from k join c on c.c >= k.k join m on m.x = c.x group by 1""",
        "gridded",
    ),
)
def pother_completeness(t: Inputs):
    p = F.col("p_a") + F.col("p_b") + F.col("p_c")
    on = t.dense.filter("meter_id in (2, 3, 4, 5) and i_an > 0.5").groupBy("x").agg(F.count_distinct("meter_id").alias("c"), F.sum(p).alias("p"))
    main = t.dense.filter("meter_id = 1 and p_a is not null").select("x", p.alias("mg"))
    j = on.join(main, "x").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    g = j.groupBy("k").agg(F.count("*").alias("n"), (F.sum("p") / 1000.0).alias("e_parts"), (F.sum("mg") / 1000.0).alias("e_main"))
    return shown(g.withColumn("pct_main", F.col("e_parts") / F.col("e_main") * 100), ["k", "n"], ["e_parts", "e_main", "pct_main"])


_C = ["c_true", "c_pred", "c_error", "delta_pct", "c_yearly"]


@query(
    "cost",
    with_tables(
        f"""with c as (select model, seed, sum(e_true) * 0.2::double as c_true, sum(e_pred) * 0.2::double as c_pred, sum(abs(e_true - e_pred)) * 0.2::double as c_error from load_metrics group by 1, 2)
        select model, seed, {_cols(['c_true', 'c_pred', 'c_error'])}, {R('abs(c_true - c_pred) / (abs(c_true) + 1e-9::double) * 100')} as delta_pct, {R('c_error * 8760.0::double / (select steps from span)')} as c_yearly from c""",
        "load_metrics", "span",
    ),
)
def cost(t: Inputs):
    return shown(balance.cost(t.load_metrics, float(t.steps)), ["model", "seed"], _C)


@query(
    "cost_by_type",
    with_tables(
        f"""with k as (select model, unnest(['observed', 'predicted', 'balance', 'inferred', 'main_meter']) as kind, unnest([sum(lo), sum(lp), sum(abs(r1_obs)), sum(ot), sum(mg)]) as e from energies group by 1)
        select model, kind, {R('e')} as e_kwh, {R('e * 0.2::double')} as c_usd, {R('e * 0.2::double * 8760 / (select steps from span)')} as c_yearly from k""",
        "energies", "span",
    ),
)
def cost_by_type(t: Inputs):
    c = balance.cost_by_type(balance.energies(t.balance, ["model", "phase"], 1.0), float(t.steps))
    return shown(c, ["model", "kind"], ["e_kwh", "c_usd", "c_yearly"])


@query(
    "cost_uncertainty",
    with_tables(
        f"with u as (select phase, u_total as u from budget where model = 'm36' and phase <> 'ABC'), v as (select * from u union all select 'total', sqrt(sum(u * u)) from u) select phase, {R('u')} as u_kwh, {R('u * 0.2::double')} as u_usd from v",
        "budget",
    ),
)
def cost_uncertainty(t: Inputs):
    return shown(balance.cost_uncertainty(budget(t), "m36"), ["phase"], ["u_kwh", "u_usd"])


# ---- tests ------------------------------------------------------------------------------------


def primary():
    """The models of the main comparison; the others are a family of their own."""
    return F.col("model").isin(*fixtures.PRIMARY)


def output_errors(t: Inputs):
    """Error per output and model; seeds are repetitions and enter by their mean."""
    return t.load_metrics.groupBy("output", "model").agg(F.avg(fixed("nae_pct", 8)).alias("nae")).withColumn("nae", fixed("nae", 8))


def pair_diffs(t: Inputs):
    """Differences of the primary models per output."""
    pairs = joins.model_pairs(output_errors(t).filter(primary()), ["output"], "model", "nae")
    return pairs.withColumn("diff", F.round(F.col("nae_a") - F.col("nae_b"), 8))


def extra_diffs(t: Inputs):
    """Differences of every other model to every primary one, per output."""
    e = output_errors(t)
    extra = e.filter(~primary()).select("output", F.col("model").alias("model_a"), F.col("nae").alias("nae_a"))
    main = e.filter(primary()).select("output", F.col("model").alias("model_b"), F.col("nae").alias("nae_b"))
    return extra.join(main, "output").withColumn("diff", F.round(F.col("nae_a") - F.col("nae_b"), 8))


def reference_diffs(t: Inputs):
    """Differences of the first model to every other one, per output."""
    e = output_errors(t)
    first = F.col("model") == fixtures.PRIMARY[0]
    a = e.filter(first).select("output", F.col("model").alias("model_a"), F.col("nae").alias("nae_a"))
    b = e.filter(~first).select("output", F.col("model").alias("model_b"), F.col("nae").alias("nae_b"))
    return a.join(b, "output").withColumn("diff", F.round(F.col("nae_a") - F.col("nae_b"), 8))


def _tested(pairs: str) -> str:
    return f"""lm as (select output, model, {R(f"avg({R('nae_pct', 8)})", 8)} as nae, any_value(family) as family from load_metrics join models using (model) group by 1, 2),
  d as (select a.model as model_a, b.model as model_b, a.output, round(a.nae - b.nae, 8) as diff from lm a join lm b on a.output = b.output and {pairs}),
  r as (select *, rank() over (partition by model_a, model_b order by abs(diff)) + (count(*) over (partition by model_a, model_b, abs(diff)) - 1) / 2.0::double as rk from d where diff <> 0),
  w as (select model_a, model_b, count(*) as n_used, coalesce(sum(rk) filter (diff > 0), 0) as wp, coalesce(sum(rk) filter (diff < 0), 0) as wm from r group by 1, 2),
  s as (select unnest(range(4096)) as k), subs as (select k, list_sum(list_transform(range(12), lambda i: ((k >> i) & 1) * (i + 1))) as total from s),
  p as (select model_a, model_b, wp, wm, n_used, least(wp, wm) as w, least(1.0::double, 2.0::double * (select count(*) from subs where k < (1::bigint << n_used) and total <= floor(least(wp, wm))) / (1::bigint << n_used)) as p_value from w)"""


_DIFFS = _tested("a.family = 'primary' and b.family = 'primary' and a.model < b.model")
AGAINST = _tested(f"a.model = '{fixtures.PRIMARY[0]}' and b.model <> a.model")
_EXTRA = _tested("a.family <> 'primary' and b.family = 'primary'")


@query(
    "wilcoxon_paired",
    with_tables(
        f"""with {_DIFFS}, b as (select model_a, model_b, count(*) as n_pairs, avg(diff) as m, stddev_pop(diff) as sd from d group by 1, 2)
        select b.model_a, b.model_b, n_pairs, {R('m')} as mean_diff, w, {R('p_value', 6)} as p_value, {R('m / (sd + 1e-12::double)')} as cohen_d from b join p on p.model_a = b.model_a and p.model_b = b.model_b""",
        "load_metrics", "models",
    ),
)
def wilcoxon_paired(t: Inputs):
    w = statistics.wilcoxon(pair_diffs(t), ["model_a", "model_b"], "diff")
    return w.select("model_a", "model_b", "n_pairs", fixed("mean_diff").alias("mean_diff"), "w", fixed("p_value", 6).alias("p_value"), fixed("cohen_d").alias("cohen_d"))


@query("rank_biserial", with_tables(f"with {_DIFFS} select model_a, model_b, {R('(wp - wm) / (n_used * (n_used + 1) / 2.0::double)', 6)} as rank_biserial from p", "load_metrics", "models"))
def rank_biserial(t: Inputs):
    w = statistics.wilcoxon(pair_diffs(t), ["model_a", "model_b"], "diff")
    return w.select("model_a", "model_b", fixed("rank_biserial", 6).alias("rank_biserial"))


def _adjusted(diffs: str) -> str:
    return with_tables(
        f"""with {diffs}, o as (select *, row_number() over (order by p_value, model_a, model_b) as i, count(*) over () as n from p)
        select model_a, model_b, {R('p_value', 6)} as p_value, {R('least(1.0::double, max((n - i + 1) * p_value) over (order by i))', 6)} as p_holm,
        {R('least(1.0::double, min(n::double / i * p_value) over (order by i rows between current row and unbounded following))', 6)} as p_bh,
        p_value < 0.05 as sig, least(1.0::double, max((n - i + 1) * p_value) over (order by i)) < 0.05 as sig_holm from o""",
        "load_metrics", "models",
    )


@query("pairwise_model_tests", _adjusted(_DIFFS))
def pairwise_model_tests(t: Inputs):
    return adjusted(pair_diffs(t))


@query("sensitivity_tests", _adjusted(_EXTRA))
def sensitivity_tests(t: Inputs):
    """The other models against the primary ones, corrected as a family of their own."""
    return adjusted(extra_diffs(t))


def adjusted(diffs):
    w = statistics.adjust(statistics.wilcoxon(diffs, ["model_a", "model_b"], "diff"))
    w = w.withColumn("sig", F.col("p_value") < 0.05).withColumn("sig_holm", F.col("p_holm") < 0.05)
    return shown(w, ["model_a", "model_b", "sig", "sig_holm"], ["p_value", "p_holm", "p_bh"], 6)


# Two-sided tail of Student's t with k degrees of freedom as a finite series. With the angle a = atan(t / sqrt(k)) of a correlation r,
# sin a = |r| and cos^2 a = 1 - r^2; the terms' factors are ratios of gamma functions, one series for even and one for odd k.
_STUDENT = """case when k % 2 = 0
  then 1 - abs(r) * list_sum(list_transform(range(k // 2), lambda j: exp(lgamma(j + 0.5::double) - lgamma(j + 1)) / sqrt(pi()) * (1 - r * r) ** j))
  else 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range((k - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5::double)) * sqrt(pi()) / 2 * sqrt(1 - r * r) ** (2 * j + 1))), 0)) end"""


@query("metric_correlation", with_tables(f"with c as (select count(*) as n, count(*) - 2 as k, corr(nae_mean, erg_pct) as r from system join models using (model) where family = 'primary') select n, {R('r', 6)} as r, {R('r * sqrt((n - 2) / (1 - r * r))')} as t_stat, {R(_STUDENT, 6)} as p_value from c", "system", "models"))
def metric_correlation(t: Inputs):
    c = evaluate.system_error(t.load_metrics).filter(primary()).agg(F.count("*").alias("n"), F.corr("nae_mean", "erg_pct").alias("r"))
    c = c.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    p = statistics.student_p("t", (F.col("n") - 2).cast("double"))
    return c.select("n", fixed("r", 6).alias("r"), fixed("t").alias("t_stat"), fixed(p, 6).alias("p_value"))


@query(
    "model_summary",
    with_tables(f"select model, any_value(family) as analysis_group, {R('avg(nae_mean)')} as nae_mean, {R('stddev_samp(nae_mean)')} as nae_sd, {R('avg(erg_pct)')} as erg_mean, {R('stddev_samp(erg_pct)')} as erg_sd from system join models using (model) group by 1", "system", "models"),
)
def model_summary(t: Inputs):
    g = evaluate.over_seeds(evaluate.system_error(t.load_metrics), ["model"], ["nae_mean", "erg_pct"])
    return g.select("model", F.when(primary(), "primary").otherwise("sensitivity").alias("analysis_group"), fixed("nae_mean_mean").alias("nae_mean"), fixed("nae_mean_sd").alias("nae_sd"), fixed("erg_pct_mean").alias("erg_mean"), fixed("erg_pct_sd").alias("erg_sd"))


@query(
    "ks_two_sample",
    f"""with v as (select l_returnflag, l_extendedprice as v, count_if(l_linestatus = 'O') as a, count_if(l_linestatus <> 'O') as b from lineitem group by 1, 2),
        c as (select l_returnflag, sum(a) over w as ca, sum(b) over w as cb, sum(a) over q as na, sum(b) over q as nb from v window w as (partition by l_returnflag order by v), q as (partition by l_returnflag)),
        d as (select l_returnflag, max(na)::bigint as n_a, max(nb)::bigint as n_b, max(abs(ca::double / na - cb::double / nb)) as d from c group by 1)
        select l_returnflag, n_a, n_b, {R('d', 6)} as d, {R('least(greatest(list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2.0::double else -2.0::double end) * exp(-2.0::double * k * k * d * d * (n_a * n_b / (n_a + n_b))))), 0), 1)', 6)} as p_value from d""",
)
def ks_two_sample(t: Inputs):
    li = t.table("lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    k = statistics.ks_two_sample(li, ["l_returnflag"], "l_extendedprice", F.col("l_linestatus") == "O")
    return k.select("l_returnflag", "n_a", "n_b", fixed("d", 6).alias("d"), fixed("p_value", 6).alias("p_value"))


_CELLS = """select gamma - 1 as load_no, seed - 1 as seed_no, avg(nae_pct) filter (model = 'm36') - avg(nae_pct) filter (model = 'm12') as delta from load_metrics group by 1, 2"""


def cells(t: Inputs):
    by = lambda m: F.avg(F.when(F.col("model") == m, F.col("nae_pct")))
    return t.load_metrics.groupBy((F.col("gamma") - 1).alias("load_no"), (F.col("seed") - 1).alias("seed_no")).agg((by("m36") - by("m12")).alias("delta"))


@query(
    "cluster_bootstrap",
    with_tables(
        f"""with c as ({_CELLS}), b as (select unnest(range(2000)) as b),
        l as (select b, {statistics.mixed_sql('1', 'b', '1', 'i')} % 4 as load_no from b, (select unnest(range(4)) as i)),
        s as (select b, {statistics.mixed_sql('1', 'b', '2', 'j')} % 5 as seed_no from b, (select unnest(range(5)) as j)),
        m as (select l.b, avg(delta) as mean_delta from l join s on s.b = l.b join c on c.load_no = l.load_no and c.seed_no = s.seed_no group by 1)
        select {R('quantile_cont(mean_delta, 0.025)')} as lo, {R('quantile_cont(mean_delta, 0.975)')} as hi, count(*) as n from m""",
        "load_metrics",
    ),
)
def cluster_bootstrap(t: Inputs):
    reps = statistics.cluster_bootstrap(cells(t), 2000)
    q = ranks.quantiles(reps, [], "mean_delta", {"lo": 0.025, "hi": 0.975})
    return q.select(fixed("lo").alias("lo"), fixed("hi").alias("hi"), "n")
