"""Channel audit and meter scope."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.operators import audit
from voltloom.plans.fixture_sql import R, add_cte, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK, VARIABLES

CH = ["meter_id", "variable"]
HARMONICS = [v for v in VARIABLES if v.startswith("hrm")]


def rows(t: Inputs):
    return t.dense.filter("p_a is not null")


def _det(idx: list[int]) -> str:
    """Determinant of the covariance matrix of some columns, written out."""
    terms = []
    for perm in permutations(range(len(idx))):
        swaps = sum(perm[j] > perm[i] for i in range(len(perm)) for j in range(i))
        cells = "*".join(f"c_{min(idx[i], idx[k])}{max(idx[i], idx[k])}" for i, k in enumerate(perm))
        terms.append(("-" if swaps % 2 else "+") + cells)
    return "(" + "".join(terms) + ")"


_COV = ", ".join(
    f"covar_pop({a}, {b}) as c_{i}{j}"
    for i, a in enumerate(["value", "p_a", "p_b", "p_c"])
    for j, b in enumerate(["value", "p_a", "p_b", "p_c"])
    if i <= j
)
_DET4 = _det([0, 1, 2, 3])
_DET3 = _det([1, 2, 3])

add_cte(
    "ortho",
    ("gridded",),
    """with b as (select meter_id, coalesce(regr_slope(p_b, p_a), 0) as b1, coalesce(regr_intercept(p_b, p_a), 0) as b0, coalesce(regr_slope(p_c, p_a), 0) as c1, coalesce(regr_intercept(p_c, p_a), 0) as c0 from gridded group by 1),
      e as (select g.meter_id, x, p_a, p_b - (b0 + b1 * p_a) as eb, p_c - (c0 + c1 * p_a) as u from gridded g join b on b.meter_id = g.meter_id),
      d as (select meter_id, coalesce(regr_slope(u, eb), 0) as k from e group by 1)
    select e.meter_id, x, p_a, eb as p_b, u - k * eb as p_c from e join d on d.meter_id = e.meter_id""",
)
add_cte(
    "long_p",
    ("samples", "gridded", "ortho"),
    "select s.meter_id, s.variable, s.x, s.value, o.p_a, o.p_b, o.p_c, case substr(ph, 1, 1) when 'a' then g.s_a when 'b' then g.s_b else g.s_c end as s_ph,"
    " case substr(ph, 1, 1) when 'a' then g.p_a when 'b' then g.p_b else g.p_c end as p_ph, fam from"
    " (select *, regexp_extract(variable, '_([abc])n?(_[0-9]+)?$', 1) as ph, regexp_extract(variable, '^(hrm_[iv]|thd[iv]|cos|[ivpqs])_', 1) as fam from samples where value is not null) s"
    " join gridded g on g.meter_id = s.meter_id and g.x = s.x join ortho o on o.meter_id = s.meter_id and o.x = s.x",
)
add_cte(
    "real",
    ("long_p",),
    "select l.*, l.value <> 0 and (not is_floor or l.value <> mode_value) as real from long_p l join (select meter_id, variable, value as mode_value, c >= 20 and n >= 10 and c >= 0.02 * n as is_floor from ("
    " select *, row_number() over (partition by meter_id, variable order by c desc, value) as rn, sum(c) over (partition by meter_id, variable) as n from"
    " (select meter_id, variable, value, count(*) as c from long_p group by 1, 2, 3)) where rn = 1) m on m.meter_id = l.meter_id and m.variable = l.variable",
)
add_cte(
    "live",
    ("real",),
    """select b.*, r.longest, n_real::double / n_rows as live_frac, coalesce(n_real < 10 or n_real::double / n_rows < 0.05 or n_unique <= 2 or longest::double / n_real > 0.5, true) as dead
    from (select meter_id, variable, any_value(fam) as fam, count(*) as n_rows, count_if(real) as n_real, count(distinct value) filter (real) as n_unique from real group by 1, 2) b
    left join (select meter_id, variable, max(n) as longest from (select meter_id, variable, value, isle, count(*) as n from (
      select meter_id, variable, value, rn - row_number() over (partition by meter_id, variable, value order by rn) as isle from (
        select meter_id, variable, value, row_number() over (partition by meter_id, variable order by x) as rn from real where real)) group by 1, 2, 3, 4) group by 1, 2) r
    on r.meter_id = b.meter_id and r.variable = b.variable""",
)
add_cte(
    "power",
    ("real", "live"),
    """select g.*, upper(substr(g.variable, 3, 1)) as phase, l.n_real, case when l.dead then 'DEAD_OR_STUCK' when l.n_unique > 10 then 'ACTIVE_POWER_VALID' else 'PHYSICAL_ALERT' end as status,
    case when rev_frac is null then 'UNKNOWN' when rev_frac < 0.05 then 'NORMAL' when rev_frac <= 0.8 then 'MIXED' else 'REVERSED_OR_BIDIRECTIONAL' end as sign_class
    from (select meter_id, variable, sum(value) filter (real) / 1000.0::double as signed_kwh, sum(abs(value)) filter (real) / 1000.0::double as abs_kwh,
      count_if(real and value < 0)::double / nullif(count_if(real), 0) as rev_frac,
      coalesce(sum(abs(value)) filter (real and value < 0), 0) / sum(abs(value)) filter (real) as rev_energy_frac,
      quantile_cont(abs(value), 0.95) filter (real) as p95_abs from real where fam = 'p' group by 1, 2) g
    join live l on l.meter_id = g.meter_id and l.variable = g.variable""",
)
_VIOL = """case when fam = 'v' then value < 1 or value > 300 when fam in ('i', 'thdi', 'thdv') then value < 0 when fam = 'cos' then abs(value) > 1
  when fam = 's' then value < 0 or value < abs(p_ph) * 0.98::double when fam = 'q' then abs(value) > s_ph * 1.02::double
  when fam in ('hrm_i', 'hrm_v') then value < 0 or value > 100 else false end"""
add_cte(
    "audit",
    ("real", "live", "power"),
    f"""select a.*, pw.status as p_status, coalesce(pw.status, case when a.dead then 'DEAD_OR_STUCK' when a.n_unique <= 10 then 'EXCLUDE' when coalesce(r2_power >= 0.95, false) then 'REDUNDANT_WITH_POWER'
      when coalesce(viol <= 0.02, false) then 'PHYSICAL_VALID' else 'PHYSICAL_ALERT' end) as channel_class
    from (select l.*, viol, r2_clock, sgn, med, mad, case when n_ok = 3 and l.n_real >= 10 and c_00 > 0 then 1 - {_DET4} / (c_00 * {_DET3}) end as r2_power from live l
      left join (select meter_id, variable, avg(case when {_VIOL} then 1.0::double else 0.0::double end) as viol, regr_r2(value, x) as r2_clock, sign(corr(value, s_ph)) as sgn, {_COV} from real where real group by 1, 2) g
        on g.meter_id = l.meter_id and g.variable = l.variable
      left join (select r.meter_id, r.variable, any_value(m.med) as med, 1.4826::double * quantile_cont(abs(value - m.med), 0.5) as mad from real r join
        (select meter_id, variable, quantile_cont(value, 0.5) as med from real where real group by 1, 2) m on m.meter_id = r.meter_id and m.variable = r.variable where real group by 1, 2) s
        on s.meter_id = l.meter_id and s.variable = l.variable
      left join (select meter_id, count_if(status = 'ACTIVE_POWER_VALID') as n_ok from power group by 1) k on k.meter_id = l.meter_id) a
    left join power pw on pw.meter_id = a.meter_id and pw.variable = a.variable""",
)


@query(
    "phase_identities",
    with_tables(
        f"""select meter_id, ph, count_if(abs(tri) > 0.1) as n_tri, count_if(abs(p / nullif(s, 0) - c) > 0.05) as n_cos, {R('max(tri)', 3)} as max_tri from (
        select *, (p * p + q * q - s * s) / nullif(s * s, 0) as tri from (select meter_id, unnest(['A', 'B', 'C']) as ph, unnest([p_a, p_b, p_c]) as p,
          unnest([q_a, q_b, q_c]) as q, unnest([s_a, s_b, s_c]) as s, unnest([cos_a, cos_b, cos_c]) as c from gridded)) group by 1, 2""",
        "gridded",
    ),
)
def phase_identities(t: Inputs):
    p = audit.by_phase(rows(t), HARMONICS)
    tri = F.try_divide(F.col("p") * F.col("p") + F.col("q") * F.col("q") - F.col("s") * F.col("s"), F.col("s") * F.col("s"))
    g = p.withColumn("tri", tri).groupBy("meter_id", F.col("phase").alias("ph")).agg(
        F.count_if(F.abs("tri") > 0.1).alias("n_tri"),
        F.count_if(F.abs(F.try_divide(F.col("p"), F.col("s")) - F.col("cos")) > 0.05).alias("n_cos"), F.max("tri").alias("m"),
    )
    return g.select("meter_id", "ph", "n_tri", "n_cos", fixed("m", 3).alias("max_tri"))


@query(
    "phase_consistency",
    with_tables(
        f"""with z as (select meter_id, x, unnest(['A', 'B', 'C']) as phase, unnest([p_a, p_b, p_c]) as p, unnest([q_a, q_b, q_c]) as q, unnest([s_a, s_b, s_c]) as s,
          unnest([cos_a, cos_b, cos_c]) as c, unnest([thdi_a, thdi_b, thdi_c]) as ti, unnest([thdv_a, thdv_b, thdv_c]) as tv, unnest([hrm_i_an_3, hrm_i_bn_3, hrm_i_cn_3]) as hi,
          unnest([hrm_v_an_5, hrm_v_bn_5, hrm_v_cn_5]) as hv, unnest(['v_an', 'v_bn', 'v_cn']) as vn from gridded),
        g as (select y.meter_id, y.phase, quantile_cont(tri, 0.5) as med, count_if(abs(tri) > 0.1)::double / nullif(count(tri), 0) as tri_viol, count_if(p < 0)::double / nullif(count_if(p <> 0), 0) as reverse,
          count_if(abs(c) > 1)::double / nullif(count(c), 0) as cos_oob, count_if(ti < 0 or tv < 0)::double / count(*) as thd_neg, count_if(hi < 0 or hi > 100 or hv < 0 or hv > 100)::double / count(*) as harm_oob,
          count_if(v.real and (v.value < 1 or v.value > 300))::double / nullif(count_if(v.real), 0) as v_oob
          from (select *, (p * p + q * q - s * s) / nullif(s * s, 0) as tri from z) y join real v on v.meter_id = y.meter_id and v.x = y.x and v.variable = y.vn group by 1, 2)
        select meter_id, phase, {R('med', 6)} as tri_median, {R('tri_viol', 6)} as tri_viol, {R('reverse', 6)} as reverse, {R('harm_oob', 6)} as harm_oob, {R('v_oob', 6)} as v_oob,
          case when coalesce(tri_viol > 0.02, false) or coalesce(cos_oob > 0.02, false) or thd_neg > 0.02 or harm_oob > 0.02 or coalesce(v_oob > 0.02, false) then 'NON_PHYSICAL' else 'PHYSICAL' end as verdict from g""",
        "gridded", "real",
    ),
)
def phase_consistency(t: Inputs):
    c = audit.phase_consistency(audit.by_phase(rows(t), HARMONICS))
    return c.select("meter_id", "phase", *[fixed(k, 6).alias(k) for k in ("tri_median", "tri_viol", "reverse", "harm_oob", "v_oob")], "verdict")


def live(t: Inputs):
    return audit.liveness(audit.real_rows(t.samples), BLOCK)


@query("dead_or_stuck", with_tables(f"select meter_id, variable, n_real, n_unique, longest, {R('live_frac', 6)} as live_frac, dead from live", "live"))
def dead_or_stuck(t: Inputs):
    return live(t).select(*CH, "n_real", "n_unique", "longest", fixed("live_frac", 6).alias("live_frac"), "dead")


def power(t: Inputs):
    r = audit.real_rows(t.samples.filter("variable in ('p_a', 'p_b', 'p_c')"))
    return t.kept("power", lambda: audit.active_power(r, audit.liveness(r, BLOCK), 1.0))


@query(
    "active_power_audit",
    with_tables(
        f"select meter_id, variable, phase, {R('signed_kwh')} as signed_kwh, {R('abs_kwh')} as abs_kwh, {R('rev_frac', 6)} as rev_frac, {R('rev_energy_frac', 6)} as rev_energy_frac, {R('p95_abs')} as p95_abs, sign_class, 'WARN' as plausibility, status from power",
        "power",
    ),
)
def active_power_audit(t: Inputs):
    p = power(t)
    return p.select(*CH, "phase", fixed("signed_kwh").alias("signed_kwh"), fixed("abs_kwh").alias("abs_kwh"), fixed("rev_frac", 6).alias("rev_frac"), fixed("rev_energy_frac", 6).alias("rev_energy_frac"), fixed("p95_abs").alias("p95_abs"), "sign_class", "plausibility", "status")


@query(
    "power_reference",
    with_tables(
        f"""with k as (select meter_id, bool_or(status = 'ACTIVE_POWER_VALID' and variable = 'p_a') as a, bool_or(status = 'ACTIVE_POWER_VALID' and variable = 'p_b') as b, bool_or(status = 'ACTIVE_POWER_VALID' and variable = 'p_c') as c from power group by 1)
        select g.meter_id, x, {R('case when a or b or c then (case when a then p_a else 0 end) + (case when b then p_b else 0 end) + (case when c then p_c else 0 end) end', 3)} as ref_total from gridded g join k on k.meter_id = g.meter_id""",
        "power", "gridded",
    ),
)
def power_reference(t: Inputs):
    return audit.power_reference(rows(t), power(t)).select("meter_id", "x", fixed("ref_total", 3).alias("ref_total"))


def full_audit(t: Inputs):
    return t.kept("audit", lambda: audit.channel_audit(rows(t), VARIABLES, 1.0, BLOCK))


@query("own_physics_check", with_tables("select meter_id, variable, coalesce(viol <= 0.02, false) as own_ok from audit where p_status is null", "audit"))
def own_physics_check(t: Inputs):
    return full_audit(t).filter("family <> 'p'").select(*CH, "own_ok")


@query("classify_channel", with_tables("select meter_id, variable, channel_class from audit", "audit"))
def classify_channel(t: Inputs):
    return full_audit(t).select(*CH, "channel_class")


@query(
    "channel_audit",
    with_tables(
        f"select meter_id, variable, n_real, n_unique, dead, {R('med')} as median, {R('mad')} as mad, case when p_status is null then {R('r2_power', 3)} end as r2_power, case when p_status is null then {R('r2_clock', 6)} end as r2_clock, case when p_status is null then coalesce(sgn, 0)::int else 0 end as sign_s, channel_class from audit",
        "audit",
    ),
)
def channel_audit(t: Inputs):
    return full_audit(t).select(*CH, "n_real", "n_unique", "dead", fixed("median").alias("median"), fixed("mad").alias("mad"), fixed("r2_power", 3).alias("r2_power"), fixed("r2_clock", 6).alias("r2_clock"), "sign_s", "channel_class")


@query(
    "energy_coherence",
    with_tables(
        f"""with g as (select phase, coalesce(sum(signed_kwh) filter (meter_id = 1), 0) as m, coalesce(sum(signed_kwh) filter (meter_id in (3, 4, 5, 6, 7)), 0) as l from power group by 1)
        select phase, {R('m')} as e_main, {R('l')} as e_loads, {R('abs(m) / (abs(l) + 1e-9::double)')} as ratio, case when abs(m) / (abs(l) + 1e-9::double) between 0.2 and 5 then 'OK' else 'WARN' end as status from g""",
        "power",
    ),
)
def energy_coherence(t: Inputs):
    c = audit.energy_coherence(power(t), [1], [3, 4, 5, 6, 7])
    return c.select("phase", *[fixed(k).alias(k) for k in ("e_main", "e_loads", "ratio")], "status")


@query(
    "eligibility",
    with_tables(
        f"select channel_class, count(*) as n, {R('count(*) * 100.0::double / sum(count(*)) over ()')} as pct, count_if(dead) as n_dead from audit group by 1",
        "audit",
    ),
)
def eligibility(t: Inputs):
    return audit.eligibility(full_audit(t)).select("channel_class", "n", fixed("pct").alias("pct"), "n_dead")
