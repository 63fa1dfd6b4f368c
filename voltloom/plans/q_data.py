"""Gap profiles, datasets, features, folds and result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.functions import names, scalars
from voltloom.functions.numeric import fixed
from voltloom.operators import aggregate, datasets, evaluate, features, gaps, grid, ranks, seq, statistics
from voltloom.plans import q_audit, q_clean, q_eval
from voltloom.plans.fixture_sql import R, add_cte, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources import fixtures
from voltloom.sources.fixtures import BLOCK, VARIABLES

CH = ["meter_id", "variable"]

add_cte("rule07", ("gaps",), """with m as (select greatest(floor(max(n) * 60 / 3), 60)::bigint as base from gaps)
  select 1 as category, 1::bigint as min_min, 60::bigint as max_min, 1 as portions from m union all select 2, 61, base, 2 from m union all select 3, base + 1, 2 * base, 3 from m union all select 4, 2 * base + 1, null, 4 from m""")
add_cte("rule06", ("gaps",), """with m as (select max(n) * 60 as mx, greatest(floor(max(n) * 60 / 3), 1)::bigint as c1, greatest(floor(max(n) * 120 / 3), floor(max(n) * 60 / 3) + 1)::bigint as c2 from gaps)
  select 1 as category, 1::bigint as min_min, c1 as max_min, 1 as portions from m union all select 2, c1 + 1, c2, 2 from m union all select 3, c2 + 1, greatest(mx, c2 + 1)::bigint, 3 from m union all select 4, greatest(mx, c2 + 1)::bigint + 1, null, 4 from m""")


def longest(t: Inputs):
    return t.gaps.agg((F.max("n") * 60).alias("max_gap_min"))


@query("gap_rule", with_tables("select 'a' as kind, * from rule07 union all select 'b', * from rule06", "rule07", "rule06"))
def gap_rule(t: Inputs):
    a = gaps.gap_rule(longest(t)).withColumn("kind", F.lit("a"))
    return a.unionByName(gaps.gap_rule(longest(t), thirds=True).withColumn("kind", F.lit("b")))


@query(
    "gap_profile",
    with_tables(
        "select meter_id, variable, count_if(category = 1) as c1, count_if(category = 2) as c2, count_if(category = 3) as c3, count_if(category = 4) as c4, sum(n * 60)::bigint as minutes"
        " from gaps join rule07 on n * 60 >= min_min and (max_min is null or n * 60 <= max_min) group by 1, 2",
        "gaps", "rule07",
    ),
)
def gap_profile(t: Inputs):
    c = gaps.classify(t.gaps, gaps.gap_rule(longest(t)), F.col("n") * 60)
    per = [F.count_if(F.col("category") == k).alias(f"c{k}") for k in range(1, 5)]
    return c.groupBy(*CH).agg(*per, F.sum("length_min").alias("minutes"))


@query(
    "gap_duration_summary",
    with_tables(
        f"""select variable, count(*) as n, min(n) as shortest, {R('quantile_cont(n, 0.25)')} as p25, {R('quantile_cont(n, 0.5)')} as p50, {R('quantile_cont(n, 0.75)')} as p75, {R('quantile_cont(n, 0.95)')} as p95, max(n) as longest, {R('avg(n)')} as mean
        from gaps group by 1""",
        "gaps",
    ),
)
def gap_duration_summary(t: Inputs):
    live = t.gaps.withColumnRenamed("n", "len")
    marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    q = ranks.quantiles(live, ["variable"], "len", marks)
    g = live.groupBy("variable").agg(F.min("len").alias("shortest"), F.max("len").alias("longest"), F.avg("len").alias("mean"))
    return q.join(g, "variable").select("variable", "n", "shortest", "longest", fixed("mean").alias("mean"), *[fixed(m).alias(m) for m in marks])


# ---- datasets ------------------------------------------------------------------------------------

_FILLED = """with n as (select *, max(case when value is not null then x end) over (partition by meter_id, variable order by x) as px,
  min(case when value is not null then x end) over (partition by meter_id, variable order by x rows between current row and unbounded following) as nx from samples where variable in ('p_a', 'p_b', 'p_c'))
  select n.meter_id, n.variable, n.x, n.value as pre, coalesce(n.value, a.value + (b.value - a.value) * (n.x - n.px) / nullif(n.nx - n.px, 0), a.value, b.value) as post
  from n left join samples a on a.meter_id = n.meter_id and a.variable = n.variable and a.x = n.px left join samples b on b.meter_id = n.meter_id and b.variable = n.variable and b.x = n.nx"""
add_cte("filled", ("samples",), _FILLED)
add_cte(
    "preserve",
    ("filled",),
    """select *, abs(e_kept - e_pre) / greatest(abs(e_pre), 1e-6) * 100 as change_pct, abs(e_total - e_pre) / greatest(abs(e_pre), 1e-6) * 100 as gain_pct, (n - n_obs) * 100.0 / n >= 99 as dead from (
    select meter_id, variable, count(*) as n, count(pre) as n_obs, count_if(pre is null and post is not null) as n_new, count_if(post is null) as n_left, coalesce(sum(pre), 0) / 1000.0::double as e_pre,
    coalesce(sum(post) filter (pre is not null), 0) / 1000.0::double as e_kept, coalesce(sum(post), 0) / 1000.0::double as e_total from filled group by 1, 2)""",
)


def powers(t: Inputs):
    return t.samples.filter("variable in ('p_a', 'p_b', 'p_c')")


def filled(t: Inputs):
    out = seq.interpolate(powers(t), CH, "value", "post", block=BLOCK)
    return out.select(*CH, "x", F.col("post").alias("value"))


def preserved(t: Inputs):
    return t.kept("preserved", lambda: datasets.energy_preservation(powers(t), filled(t), 1.0))


@query(
    "energy_preservation",
    with_tables(f"select meter_id, variable, n_obs, n_new, n_left, {R('e_pre')} as e_pre, {R('e_total')} as e_total, {R('change_pct')} as change_pct, {R('gain_pct', 3)} as gain_pct, dead from preserve", "preserve"),
)
def energy_preservation(t: Inputs):
    p = preserved(t)
    return p.select(*CH, "n_obs", "n_new", "n_left", fixed("e_pre").alias("e_pre"), fixed("e_total").alias("e_total"), fixed("change_pct").alias("change_pct"), fixed("gain_pct", 3).alias("gain_pct"), "dead")


@query(
    "channel_roles",
    with_tables(
        "select p.meter_id, variable, case when d.role is null then 'outside_scope' when dead then 'dead' when abs(e_pre) >= 1 and change_pct > 5 then 'blocked' when role = 'm_g_input' then 'M_G_input' when role = 'modeled_loads' then 'Gamma_i' when role = 'p_other_components' then 'P_other' else 'excluded_unassigned' end as role_final from preserve p left join (select * from meter_dim where meter_id <> 8) d on d.meter_id = p.meter_id",
        "preserve", "meter_dim",
    ),
)
def channel_roles(t: Inputs):
    return datasets.channel_roles(preserved(t), t.meter_dim.filter("meter_id <> 8")).select(*CH, "role_final")


@query(
    "mask_dead_blocked",
    with_tables(
        "select s.meter_id, s.variable, count(case when a.dead then null else s.value end) as n from samples s join live a on a.meter_id = s.meter_id and a.variable = s.variable group by 1, 2",
        "samples", "live",
    ),
)
def mask_dead_blocked(t: Inputs):
    verdict = q_audit.full_audit(t).select(*CH, "dead", F.lit(False).alias("blocked"))
    return datasets.mask_channels(t.samples, verdict).groupBy(*CH).agg(F.count("value").alias("n"))


@query(
    "supported_reference",
    with_tables("select s.meter_id, s.variable, count(case when code <> 3 then 1 end) as n_supported, count(*) as n from conf s group by 1, 2", "conf"),
)
def supported_reference(t: Inputs):
    return t.conf.groupBy(*CH).agg(F.count(F.when(F.col("code") != 3, 1)).alias("n_supported"), F.count("*").alias("n"))


_OUT = [f"{s}_{p}" for s in ("M_G", "G1", "G2", "G3", "G4", "P_other") for p in "ABC"]


@query(
    "scenario_matrix",
    with_tables(
        "select x, " + ", ".join(f"{R(f'sum(value) filter (o = $${o}$$)')} as \"{o}\"" for o in _OUT)
        + " from (select x, value, case role when 'm_g_input' then 'M_G' when 'modeled_loads' then 'G' || gamma_id else 'P_other' end || '_' || upper(substr(variable, 3, 1)) as o from samples s join meter_dim d on d.meter_id = s.meter_id"
        " where variable in ('p_a', 'p_b', 'p_c') and role in ('m_g_input', 'modeled_loads', 'p_other_components')) group by 1",
        "samples", "meter_dim",
    ),
)
def scenario_matrix(t: Inputs):
    m = datasets.scenario_matrix(datasets.scenario_long(t.samples, t.meter_dim), _OUT)
    return m.select("x", *[fixed(o).alias(o) for o in _OUT])


@query(
    "same_load_test",
    with_tables(
        f"""with r as (select variable, meter_id, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, count(*) as n from real where meter_id in (5, 6) and real group by 1, 2)
        select a.variable, a.n as n_a, b.n as n_b, {R('b.med / nullif(a.med, 0)')} as ratio, {R('b.iqr / nullif(a.iqr, 0)')} as iqr_ratio from r a join r b on a.variable = b.variable and a.meter_id = 5 and b.meter_id = 6""",
        "real",
    ),
)
def same_load_test(t: Inputs):
    from voltloom.operators import audit

    r = audit.real_rows(t.samples.filter("meter_id in (5, 6)")).filter("real")
    q = ranks.quantiles(r, ["variable", "meter_id"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    a = q.filter("meter_id = 5").select("variable", F.col("n").alias("n_a"), F.col("med").alias("ma"), (F.col("q3") - F.col("q1")).alias("ia"))
    b = q.filter("meter_id = 6").select("variable", F.col("n").alias("n_b"), F.col("med").alias("mb"), (F.col("q3") - F.col("q1")).alias("ib"))
    zero = F.lit(0.0)
    return a.join(b, "variable").select("variable", "n_a", "n_b", fixed(F.col("mb") / F.nullif("ma", zero)).alias("ratio"), fixed(F.col("ib") / F.nullif("ia", zero)).alias("iqr_ratio"))


@query(
    "energy_by_stage",
    with_tables(
        f"""with raw_e as (select meter_id, variable, coalesce(sum(w), 0) / 3600000.0::double as e from (select meter_id, variable, 0.5 * (value + lead(value) over w) * least(greatest((epoch_us(lead(time) over w) - epoch_us(time)) / 1000000.0::double, 0), 300) as w
          from (select meter_id, time, unnest(['p_a', 'p_b', 'p_c']) as variable, unnest([p_a, p_b, p_c]) as value from readings) where value is not null window w as (partition by meter_id, variable order by time)) group by 1, 2),
        g as (select meter_id, variable, coalesce(sum(pre), 0) / 1000.0::double as e, coalesce(sum(post), 0) / 1000.0::double as f from filled group by 1, 2),
        c as (select s.meter_id, s.variable, coalesce(sum(case when m.x is null and o.x is null then s.value end), 0) / 1000.0::double as e from samples s left join mask m on m.meter_id = s.meter_id and m.variable = s.variable and m.x = s.x
          left join outliers o on o.meter_id = s.meter_id and o.variable = s.variable and o.x = s.x where s.variable in ('p_a', 'p_b', 'p_c') group by 1, 2)
        select r.meter_id, upper(substr(r.variable, 3, 1)) as phase, {R('r.e')} as raw, {R('g.e')} as gridded, {R('c.e')} as clean, {R('g.f')} as filled, {R('(c.e - g.e) / greatest(abs(g.e), 1e-6) * 100')} as clean_vs_grid, abs((c.e - g.e) / greatest(abs(g.e), 1e-6) * 100) > 5 as alert
        from raw_e r join g on g.meter_id = r.meter_id and g.variable = r.variable join c on c.meter_id = r.meter_id and c.variable = r.variable""",
        "readings", "filled", "samples", "mask", "outliers",
    ),
)
def energy_by_stage(t: Inputs):
    from voltloom.operators import clean

    long = grid.to_long(t.readings, ["meter_id", "time"], ["p_a", "p_b", "p_c"]).filter("value is not null")
    m = q_clean.masked(t)
    cleaned = clean.apply_masks(powers(t), m, q_clean.points(t, m)).select(*CH, F.col("clean").alias("value"))
    parts = {
        "raw": aggregate.energy_trapezoid(long, CH, "time", "value", slot_hours=168),
        "gridded": aggregate.energy_uniform(powers(t), CH, F.col("value"), 1.0),
        "clean": aggregate.energy_uniform(cleaned, CH, F.col("value"), 1.0),
        "filled": aggregate.energy_uniform(filled(t), CH, F.col("value"), 1.0),
    }
    rows = None
    for name, df in parts.items():
        one = df.select("meter_id", F.upper(names.phase_of("variable")).alias("phase"), F.lit(name).alias("stage"), "kwh")
        rows = one if rows is None else rows.unionByName(one)
    r = datasets.relative_steps(rows)
    return r.select("meter_id", "phase", *[fixed(c).alias(c) for c in ("raw", "gridded", "clean", "filled", "clean_vs_grid")], "alert")


@query(
    "pother_breakdown",
    with_tables(f"select phase, meter_id, {R('sum(p) / 1000.0::double')} as kwh, {R('sum(p) / sum(sum(p)) over (partition by phase) * 100')} as pct from parts where meter_id in (2, 4) group by 1, 2", "parts"),
)
def pother_breakdown(t: Inputs):
    from voltloom.operators import balance

    s = balance.component_shares(fixtures.component_power(t.dense, fixtures.COMPONENTS))
    return s.select("phase", "meter_id", fixed(F.col("e") / 1000.0).alias("kwh"), fixed(F.col("frac") * 100).alias("pct"))


@query("feature_matrix", with_tables("select variable as feature, count(*) as n, count_if(value is null) as n_null from samples where meter_id = 1 group by 1", "samples"))
def feature_matrix(t: Inputs):
    x = t.dense.filter("meter_id = 1").drop("meter_id", "x")
    return aggregate.null_inventory(x, x.columns).select(F.col("column_name").alias("feature"), F.col("n_rows").alias("n"), "n_null")


@query(
    "target_validity",
    with_tables("select meter_id, variable, count_if(code = 0) as n_obs, count_if(code in (0, 1, 2)) as n_supported, count(*) as n_complete from conf where variable in ('p_a', 'p_b', 'p_c') group by 1, 2", "conf"),
)
def target_validity(t: Inputs):
    v = datasets.target_validity(t.conf.filter("variable in ('p_a', 'p_b', 'p_c')"))
    return v.groupBy(*CH).agg(F.count_if("obs").alias("n_obs"), F.count_if("supported").alias("n_supported"), F.count_if("complete").alias("n_complete"))


@query(
    "masked_time_folds",
    with_tables(
        """with m as (select t.output, t.x, code = 0 as ok from truth t join conf c on c.meter_id = t.meter_id and c.variable = t.variable and c.x = t.x), f as (select unnest([0, 1, 2, 3, 4]) as fold)
        select output, f.fold, count_if(ok and x < s.first + f.fold * s.fold) as n_train, count_if(ok and x >= s.first + f.fold * s.fold and x < s.first + (f.fold + 1) * s.fold) as n_valid from m, f, span s group by 1, 2 having n_train >= 50 and n_valid >= 30""",
        "truth", "conf", "span",
    ),
)
def masked_time_folds(t: Inputs):
    m = t.truth.select("output", "meter_id", "variable", "x").join(t.conf, [*CH, "x"]).select("output", "x", (F.col("code") == 0).alias("ok"))
    return datasets.time_folds(m, t.steps)


@query(
    "input_blocks",
    with_tables(
        """select a.variable as feature, channel_class, a.fam as family, channel_class = 'PHYSICAL_VALID' as in_x0, channel_class in ('PHYSICAL_VALID', 'REDUNDANT_WITH_POWER', 'ACTIVE_POWER_VALID') as in_x1 from audit a where meter_id = 1""",
        "audit",
    ),
)
def input_blocks(t: Inputs):
    a = q_audit.full_audit(t).filter("meter_id = 1")
    c = F.col("channel_class")
    return a.select(
        F.col("variable").alias("feature"), "channel_class", names.family_of("variable").alias("family"),
        (c == "PHYSICAL_VALID").alias("in_x0"), c.isin("PHYSICAL_VALID", "REDUNDANT_WITH_POWER", "ACTIVE_POWER_VALID").alias("in_x1"),
    )


@query(
    "one_se_rule",
    with_tables(
        f"""with s as (select output as "set", gamma as n_features, seed, avg(nae_pct) as nae from load_metrics group by 1, 2, 3), g as (select "set", n_features, avg(nae) as m, stddev_samp(nae) / sqrt(count(*)) as se from s group by 1, 2),
        l as (select m + se as lim from g order by m, "set" limit 1), w as (select *, m <= lim as within from g, l)
        select "set", n_features, {R('m')} as mean_nae, {R('se')} as se, within, within and "set" = first_value("set") over (order by within desc, n_features, "set") as chosen from w""",
        "load_metrics",
    ),
)
def one_se_rule(t: Inputs):
    s = t.load_metrics.groupBy(F.col("output").alias("set"), F.col("gamma").alias("n_features"), "seed").agg(F.avg("nae_pct").alias("nae"))
    r = datasets.one_se_rule(s)
    return r.select("set", "n_features", fixed("mean_nae").alias("mean_nae"), fixed("se").alias("se"), "within", "chosen")


@query(
    "selection_frequency",
    with_tables(
        f"""with c as (select t.output, s.variable as feature, {R('abs(corr(t.y, s.value))', 6)} as r from truth t join samples s on s.x = t.x and s.value is not null
          join meter_dim d on d.meter_id = s.meter_id and d.role = 'm_g_input' group by 1, 2),
        k as (select *, row_number() over (partition by output order by r desc, feature) as rank from c where r is not null)
        select feature, count(*) as n_selected, case when feature like 'hrm%' or feature like 'thd%' then 'harmonic' else 'fundamental' end as type from k where rank <= 10 group by 1""",
        "truth", "samples", "meter_dim",
    ),
)
def selection_frequency(t: Inputs):
    """By how many outputs a quantity of the main meter is selected: each output takes the ten of largest correlation."""
    return features.selection_frequency(selected_features(t), names.is_harmonic("feature"))


def selected_features(t: Inputs):
    main = t.dense.join(F.broadcast(t.meter_dim.filter("role = 'm_g_input'").select("meter_id")), "meter_id").drop("meter_id")
    return features.by_correlation(t.truth.select("output", "x", "y").join(main, "x"), ["output"], VARIABLES, "y", 10)


@query("energy_stage_totals", with_tables(f"select upper(substr(variable, 3, 1)) as phase, {R('sum(abs(e_pre))')} as observed, {R('sum(abs(e_total))')} as filled from preserve group by 1", "preserve"))
def energy_stage_totals(t: Inputs):
    g = preserved(t).groupBy(F.upper(names.phase_of("variable")).alias("phase")).agg(F.sum(F.abs("e_pre")).alias("a"), F.sum(F.abs("e_total")).alias("b"))
    return g.select("phase", fixed("a").alias("observed"), fixed("b").alias("filled"))


# ---- result tables ----------------------------------------------------------------------------------


@query(
    "extended_metrics",
    with_tables(f"select model, {R('avg(nae_mean)')} as nae, {R('avg(erg_pct)')} as erg, {R('100 - avg(erg_pct)')} as aae from system group by 1", "system"),
)
def extended_metrics(t: Inputs):
    g = evaluate.system_error(t.load_metrics).groupBy("model").agg(F.avg("nae_mean").alias("nae"), F.avg("erg_pct").alias("erg"))
    return g.select("model", fixed("nae").alias("nae"), fixed("erg").alias("erg"), fixed(100 - F.col("erg")).alias("aae"))


@query("best_model", with_tables("select arg_min(model, nae) as best_nae, arg_min(model, erg) as best_erg from (select model, avg(nae_mean) as nae, avg(erg_pct) as erg from system join models using (model) where family = 'primary' group by 1)", "system", "models"))
def best_model(t: Inputs):
    g = evaluate.system_error(t.load_metrics).filter(q_eval.primary()).groupBy("model").agg(F.avg("nae_mean").alias("nae"), F.avg("erg_pct").alias("erg"))
    return g.agg(F.min_by("model", F.struct("nae", "model")).alias("best_nae"), F.min_by("model", F.struct("erg", "model")).alias("best_erg"))


@query(
    "model_table",
    with_tables(
        f"""with {q_eval.AGAINST}, b as (select model_b as model, avg(diff) as m, stddev_pop(diff) as sd from d group by 1),
        summary as (select model, any_value(family) as analysis_group, avg(nae_mean) as nae, stddev_samp(nae_mean) as nae_sd, avg(erg_pct) as erg, stddev_samp(erg_pct) as erg_sd from system join models using (model) group by 1)
        select s.model, analysis_group, {R('nae')} as nae_mean, {R('nae_sd')} as nae_sd, {R('erg')} as erg_mean, {R('erg_sd')} as erg_sd, {R('m / (sd + 1e-12::double)')} as cohen_d, {R('p_value', 6)} as p_value,
        case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' when p_value is not null then 'ns' end as sig from summary s left join b on b.model = s.model left join p on p.model_b = s.model""",
        "system", "models", "load_metrics",
    ),
)
def model_table(t: Inputs):
    """Errors of every model and its paired test against the first one."""
    s = q_eval.model_summary(t)
    w = statistics.wilcoxon(q_eval.reference_diffs(t), ["model_a", "model_b"], "diff").select(
        F.col("model_b").alias("model"), fixed("cohen_d").alias("cohen_d"), "p_value"
    )
    j = s.join(w, "model", "left").withColumn("sig", F.when(F.col("p_value").isNotNull(), scalars.sig_stars("p_value")))
    return j.withColumn("p_value", fixed("p_value", 6))


@query("channel_limits", with_tables(f"select meter_id, variable, {R('quantile_cont(value, 0.005)')} as lo, {R('quantile_cont(value, 0.995)')} as hi from samples where value is not null group by 1, 2", "samples"))
def channel_limits(t: Inputs):
    q = ranks.quantiles(t.samples, CH, "value", {"lo": 0.005, "hi": 0.995})
    return q.select(*CH, fixed("lo").alias("lo"), fixed("hi").alias("hi"))


@query(
    "display_regions",
    with_tables("select 'gap' as kind, meter_id, variable, x0, x1 from gaps where variable in ('p_a', 'p_b', 'p_c') union all select 'outlier', meter_id, variable, x, x from outliers where variable in ('p_a', 'p_b', 'p_c')", "gaps", "outliers"),
)
def display_regions(t: Inputs):
    power = F.col("variable").isin("p_a", "p_b", "p_c")
    g = t.gaps.filter(power).select(F.lit("gap").alias("kind"), *CH, "x0", "x1")
    o = q_clean.points(t, q_clean.masked(t)).filter(power)
    return g.unionByName(o.select(F.lit("outlier").alias("kind"), *CH, F.col("x").alias("x0"), F.col("x").alias("x1")))


@query(
    "display_phase",
    with_tables(
        """with l as (select meter_id, variable, max(n) as longest from gaps group by 1, 2), k as (select p.meter_id, p.variable, p.sign_class = 'REVERSED_OR_BIDIRECTIONAL' as rev, coalesce(longest, 0) as longest, p.n_real from power p left join l on l.meter_id = p.meter_id and l.variable = p.variable)
        select meter_id, variable from (select *, row_number() over (partition by meter_id order by rev, longest, n_real desc, variable) as rn from k) where rn = 1""",
        "power", "gaps",
    ),
)
def display_phase(t: Inputs):
    from voltloom.operators import audit

    longest_gap = t.gaps.groupBy(*CH).agg(F.max("n").alias("longest"))
    r = audit.real_rows(powers(t)).groupBy(*CH).agg(F.count_if("real").alias("n_real"))
    j = q_audit.power(t).join(longest_gap, CH, "left").join(r, CH).withColumn("longest", F.coalesce("longest", F.lit(0)))
    w = Window.partitionBy("meter_id").orderBy(F.col("sign_class") == "REVERSED_OR_BIDIRECTIONAL", "longest", F.desc("n_real"), "variable")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*CH)


@query(
    "joined_audit",
    with_tables(f"select p.meter_id, p.phase, p.status, p.sign_class, {R('e.e_pre')} as kwh from power p left join preserve e on e.meter_id = p.meter_id and e.variable = p.variable", "power", "preserve"),
)
def joined_audit(t: Inputs):
    return q_audit.power(t).join(preserved(t).select(*CH, "e_pre"), CH, "left").select("meter_id", "phase", "status", "sign_class", fixed("e_pre").alias("kwh"))


@query("uncertainty_table", with_tables(f"select model, phase, component, {R('u')} as u_kwh from (select model, phase, unnest(['u_met', 'u_seed', 'u_sync', 'u_total']) as component, unnest([u_met, u_seed, u_sync, u_total]) as u from budget)", "budget"))
def uncertainty_table(t: Inputs):
    b = q_eval.budget(t).unpivot(["model", "phase"], ["u_met", "u_seed", "u_sync", "u_total"], "component", "u")
    return b.select("model", "phase", "component", fixed("u").alias("u_kwh"))


@query(
    "dataset_summary",
    with_tables(
        "select 'rows' as key, count(*)::double as value from readings union all select 'meters', count(distinct meter_id) from readings union all select 'channels', count(*) from live union all select 'dead_channels', count_if(dead) from live union all select 'gaps', count(*) from gaps",
        "readings", "live", "gaps",
    ),
)
def dataset_summary(t: Inputs):
    a = t.readings.agg(F.count("*").alias("rows"), F.count_distinct("meter_id").alias("meters")).unpivot([], ["rows", "meters"], "key", "value")
    b = q_audit.full_audit(t).agg(F.count("*").alias("channels"), F.count_if("dead").alias("dead_channels")).unpivot([], ["channels", "dead_channels"], "key", "value")
    c = t.gaps.agg(F.count("*").alias("gaps")).unpivot([], ["gaps"], "key", "value")
    return a.unionByName(b).unionByName(c).select("key", F.col("value").cast("double").alias("value"))
