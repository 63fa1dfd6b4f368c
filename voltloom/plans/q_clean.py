"""Meter scope, placeholders and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed, safe_corr
from voltloom.operators import clean, joins, scope, seq
from voltloom.plans.fixture_sql import R, add_cte, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK

CH = ["meter_id", "variable"]
CUR = "('i_an', 'i_bn', 'i_cn')"

# ---- scope ------------------------------------------------------------------------------------

add_cte(
    "prelim",
    ("samples",),
    f"""select m.*, amp, dominant_frac, case when n_finite < 10 then 'insufficient_finite' when dominant_frac >= 0.8 then 'dominant_horizontal_value'
      when n_unique < 4 and amp <= 1e-9 then 'constant_or_quasi_constant_column' when amp <= 1e-9 then 'zero_robust_amplitude' else 'real_variation' end as rule
    from (select meter_id, variable, value as dominant_value, c as mode_count, n_finite, n_unique, c::double / n_finite as dominant_frac from (
      select *, row_number() over (partition by meter_id, variable order by c desc, value) as rn, sum(c) over (partition by meter_id, variable) as n_finite, count(*) over (partition by meter_id, variable) as n_unique
      from (select meter_id, variable, value, count(*) as c from samples where variable in {CUR} and value is not null group by 1, 2, 3)) where rn = 1) m
    join (select meter_id, variable, abs(quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) as amp from samples group by 1, 2) q on q.meter_id = m.meter_id and q.variable = m.variable""",
)
add_cte(
    "quality",
    ("samples", "prelim"),
    """select meter_id, count(*) as n_rows, sum(cells)::bigint as n_finite, sum(sent)::bigint as n_sentinel, count_if(useful) as n_useful, sum(sent) * 100.0::double / sum(cells) as pct_sentinel,
      count_if(useful) * 100.0::double / count(*) as pct_useful from (
      select s.meter_id, s.x, count(*) as cells, count_if(f) as sent, bool_or(not f) as useful from (select s.*, case when rule = 'dominant_horizontal_value' then abs(value - dominant_value) <= 1e-6
        else rule in ('constant_or_quasi_constant_column', 'zero_robust_amplitude') end as f from samples s join prelim p on p.meter_id = s.meter_id and p.variable = s.variable where value is not null) s group by 1, 2) group by 1""",
)


def current_cells(t: Inputs):
    return t.samples.filter(f"variable in {CUR}")


def prelim(t: Inputs):
    return t.kept("prelim", lambda: scope.prelim_sentinel(current_cells(t)))


@query(
    "prelim_sentinel",
    with_tables(
        f"select meter_id, variable, n_finite::bigint as n_finite, n_unique, dominant_value, {R('dominant_frac', 6)} as dominant_frac, {R('amp')} as amp, rule, case when rule = 'dominant_horizontal_value' then mode_count when rule in ('constant_or_quasi_constant_column', 'zero_robust_amplitude') then n_finite else 0 end::bigint as n_sentinel from prelim",
        "prelim",
    ),
)
def prelim_sentinel(t: Inputs):
    return scope.prelim_sentinel(current_cells(t)).withColumn("dominant_frac", fixed("dominant_frac", 6)).withColumn("amp", fixed("amp"))


def quality(t: Inputs):
    return scope.energy_quality(scope.sentinel_cells(current_cells(t), prelim(t)))


@query("energy_quality", with_tables(f"select meter_id, n_rows, n_finite, n_sentinel, n_useful, {R('pct_sentinel')} as pct_sentinel, {R('pct_useful')} as pct_useful from quality", "quality"))
def energy_quality(t: Inputs):
    return quality(t).withColumn("pct_sentinel", fixed("pct_sentinel")).withColumn("pct_useful", fixed("pct_useful"))


@query(
    "scope_decision",
    with_tables(
        """with r as (select *, n_rows::double / max(n_rows) over () as cov, case when meter_id = 2 then 'excluded_force_drop' when meter_id = 1 then 'main' when meter_id in (3, 4, 5, 6, 7, 8) then 'candidate' else 'not_candidate' end as role from quality),
        v as (select *, case when role = 'candidate' and pct_sentinel >= 60 then 'excluded_sentinel' when role = 'candidate' and pct_useful < 40 then 'excluded_useful' when role = 'candidate' and cov < 0.5 then 'excluded_coverage' else role end as verdict from r)
        select meter_id, verdict, verdict in ('main', 'candidate') as process from v""",
        "quality",
    ),
)
def scope_decision(t: Inputs):
    return scope.decide(quality(t), main=[1], candidates=[3, 4, 5, 6, 7, 8], drop=[2]).select("meter_id", "verdict", "process")


_PAIRS = f"""with k as (select meter_id, x, i_an, i_bn, i_cn from gridded where i_an is not null), n as (select meter_id, count(*) as n, max(count(*)) over () as n_ref from k group by 1),
  j as (select a.meter_id as a, b.meter_id as b, count(*) as overlap, corr(a.i_an, b.i_an) as r1, corr(a.i_bn, b.i_bn) as r2, corr(a.i_cn, b.i_cn) as r3,
    quantile_cont(abs(a.i_an), 0.5) as a1, quantile_cont(abs(b.i_an), 0.5) as b1, quantile_cont(abs(a.i_bn), 0.5) as a2, quantile_cont(abs(b.i_bn), 0.5) as b2, quantile_cont(abs(a.i_cn), 0.5) as a3, quantile_cont(abs(b.i_cn), 0.5) as b3
    from k a join k b on a.x = b.x and a.meter_id < b.meter_id group by 1, 2),
  p as (select na.meter_id as a, nb.meter_id as b, coalesce(overlap, 0) as overlap, (na.n + nb.n - coalesce(overlap, 0))::double / na.n_ref as union_frac, coalesce(overlap, 0) >= 200 as tested, least(na.n, nb.n) as small, na.n::double / na.n_ref as ca, nb.n::double / nb.n_ref as cb,
    list_avg(list_filter([case when isfinite(r1) then r1 end, case when isfinite(r2) then r2 end, case when isfinite(r3) then r3 end], lambda v: v is not null)) as r, (abs(a1 - b1) / greatest(a1, b1) + abs(a2 - b2) / greatest(a2, b2) + abs(a3 - b3) / greatest(a3, b3)) / 3 as m
    from n na join n nb on na.meter_id < nb.meter_id left join j on j.a = na.meter_id and j.b = nb.meter_id)"""


@query(
    "duplicate_meters",
    with_tables(
        f"""{_PAIRS} select a, b, overlap, {R('union_frac', 6)} as union_frac, case when tested then {R('coalesce(r, 0)', 5)} end as corr, case when tested then {R('m', 5)} end as mag,
        coalesce(tested and coalesce(r, 0) >= 0.999 and m <= 0.05, false) as overlapping, overlap::double / small <= 0.05 and ca < 0.9 and cb < 0.9 and union_frac >= 0.8 as interleaved from p""",
        "gridded",
    ),
)
def duplicate_meters(t: Inputs):
    p = t.kept("pairs", lambda: scope.duplicate_pairs(t.dense, ["i_an", "i_bn", "i_cn"], BLOCK))
    return p.select("a", "b", "overlap", fixed("union_frac", 6).alias("union_frac"), fixed("corr", 5).alias("corr"), fixed("mag", 5).alias("mag"), "overlapping", "interleaved")


@query(
    "duplicate_groups",
    with_tables(
        f"""{_PAIRS}, e as (select least(a, b) as lo, greatest(a, b) as hi from p where tested and coalesce(r, 0) >= 0.999 and m <= 0.05),
        c as (select g.meter_id, count(*) as common, corr(g.i_an, q.i_an) as c1, corr(g.i_bn, q.i_bn) as c2, corr(g.i_cn, q.i_cn) as c3 from k g join k q on q.meter_id = 1 and q.x = g.x group by 1),
        m as (select n.meter_id, case when n.meter_id = 1 then 1 when common >= 200 then list_avg(list_filter([c1, c2, c3], lambda v: isfinite(v))) end as corr_main from n left join c on c.meter_id = n.meter_id)
        select m.meter_id, coalesce(e.lo, m.meter_id) as component, case when e.lo is null and not exists (select 1 from e where e.lo = m.meter_id) then 1 else 2 end as members, e.lo is null as kept,
          floor(corr_main * 1000000 + 0.50031) / 1000000 as corr_main from m left join e on e.hi = m.meter_id""",
        "gridded",
    ),
)
def duplicate_groups(t: Inputs):
    pairs = t.kept("pairs", lambda: scope.duplicate_pairs(t.dense, ["i_an", "i_bn", "i_cn"], BLOCK))
    m = scope.main_correlation(t.dense, ["i_an", "i_bn", "i_cn"], 1)
    m = t.kept("main_correlation", lambda: m.withColumn("corr_main", fixed("corr_main", 6)))
    return scope.duplicate_groups(m, pairs, [1]).join(m.select("meter_id", "corr_main"), "meter_id")


@query(
    "connected_components",
    """with g as (select c_custkey as id, c_custkey - row_number() over (partition by c_mktsegment order by c_custkey) as isle, c_mktsegment as s from customer)
       select id, min(id) over (partition by s, isle) as component from g""",
)
def connected_components(t: Inputs):
    c = t.table("customer").select(F.col("c_custkey").alias("a"), "c_mktsegment")
    nxt = c.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), "c_mktsegment")
    edges = c.join(nxt, ["a", "c_mktsegment"]).select("a", "b")
    return joins.connected_components(c.select(F.col("a").alias("id")), edges)


@query(
    "pother_routing",
    with_tables(
        "select d.meter_id, case when role = 'p_other_components' then 'routed_to_100' else role end as route, count(value) as n from samples s join meter_dim d on d.meter_id = s.meter_id group by 1, 2",
        "samples", "meter_dim",
    ),
)
def pother_routing(t: Inputs):
    n = t.samples.groupBy("meter_id").agg(F.count("value").alias("n"))
    route = F.when(F.col("role") == "p_other_components", "routed_to_100").otherwise(F.col("role"))
    return joins.with_dim(n, t.meter_dim, ["meter_id"]).select("meter_id", route.alias("route"), "n")


@query(
    "row_filter_summary",
    with_tables(f"select count(*) as n_in, count_if(meter_id in (1, 3, 5, 6)) as n_out, {R('count_if(meter_id in (1, 3, 5, 6)) * 100.0::double / count(*)')} as pct from readings", "readings"),
)
def row_filter_summary(t: Inputs):
    keep = F.col("meter_id").isin(1, 3, 5, 6)
    g = t.readings.agg(F.count("*").alias("n_in"), F.count_if(keep).alias("n_out"))
    return g.withColumn("pct", fixed(F.col("n_out") * 100.0 / F.col("n_in")))


# ---- placeholders -------------------------------------------------------------------------------

add_cte(
    "floors",
    ("samples",),
    """select variable, v as floor_value, c as n_floor, n as n_finite, second from (select *, row_number() over (partition by variable order by c desc, v) as rn, sum(c) over (partition by variable)::bigint as n,
      count(*) over (partition by variable) as d, coalesce(nth_value(c, 2) over (partition by variable order by c desc, v rows between unbounded preceding and unbounded following), 0) as second
      from (select variable, round(value, 6) as v, count(*) as c from samples where value is not null group by 1, 2))
    where rn = 1 and n >= 50 and d >= 2 and c >= greatest(50, floor(n * 0.005)) and c >= greatest(20 * greatest(second, 1), 50)""",
)
add_cte(
    "flagged",
    ("samples", "floors"),
    "select s.*, coalesce(abs(round(value, 6) - floor_value) <= 5e-6, false) as exact from samples s left join floors f on f.variable = s.variable",
)


def plateau_sql(src: str) -> str:
    fam = "regexp_extract(variable, '^(hrm_[iv]|thd[iv]|cos|[ivpqs])_', 1)"
    return f"""(with use as (select *, {fam} as fam, round_even(value, 3) as r3 from {src} where value is not null and not exact and {fam} not in ('v', 'thdv', 'hrm_v', 'cos')),
      st as (select meter_id, variable, any_value(fam) as fam, count(*) as n, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75, quantile_cont(value, 0.95) as q95 from use group by 1, 2),
      s2 as (select *, greatest(q75 - q25, q95 - q05, 1e-9) as scale from st where n >= 30 and not (fam in ('p', 'q') and q50 < 0)),
      g as (select meter_id, variable, r3 as lower, count(*) as c, count_if(value <= r3 + 1e-9) as c_low, count_if(value >= r3 - 1e-9) as c_up from use group by 1, 2, 3),
      h as (select *, sum(c) over w - c as before, lead(lower) over w - lower as gap, lead(c) over w as next_c, lead(c_up) over w as next_up from g window w as (partition by meter_id, variable order by lower)),
      k as (select h.*, s2.n, scale, fam, before + c_low as n_low, s2.n - before - c - next_c + next_up as n_up, (before + c_low)::double / s2.n as share from h join s2 on s2.meter_id = h.meter_id and s2.variable = h.variable),
      b as (select meter_id, variable, lower from (select *, row_number() over (partition by meter_id, variable order by gap * least(share, 1 - share) desc, lower) as rn from k
        where gap is not null and not (fam in ('p', 'q', 's', 'cos') and abs(lower) <= greatest(1e-9, 0.002 * greatest(scale, 1))) and n_low >= 3 and n_up >= 3 and share between 0.005 and 0.95 and gap >= greatest(0.03 * scale, 1e-6)) where rn = 1),
      cand as (select use.meter_id, use.variable, x, x - row_number() over (partition by use.meter_id, use.variable order by x) as isle from use join b on b.meter_id = use.meter_id and b.variable = use.variable where value <= lower + 1e-9)
      select * from b where exists (select 1 from (select meter_id, variable from cand group by meter_id, variable, isle having count(*) >= 3) z where z.meter_id = b.meter_id and z.variable = b.variable))"""


add_cte("plateau", ("flagged",), plateau_sql("flagged"))
add_cte("cur", ("flagged",), f"select * from flagged where variable in {CUR}")
add_cte("plain_cur", ("cur",), "select meter_id, variable, x, value, false as exact from cur")
add_cte("plateau_cur", ("plain_cur",), plateau_sql("plain_cur"))
add_cte(
    "nosignal",
    ("cur", "plain_cur", "plateau_cur"),
    """with st as (select meter_id, x, count(value) = 3 as f, bool_or(exact) as hit from cur group by 1, 2), an as (select meter_id, x from st where f and hit),
      o as (select *, case when x - lag(x) over (partition by meter_id order by x) - 1 <= 35 then 0 else 1 end as nw from an),
      sg as (select meter_id, min(x) as x0, max(x) as x1 from (select *, sum(nw) over (partition by meter_id order by x) as g from o) group by meter_id, g having max(x) - min(x) + 1 >= 3),
      inn as (select s.meter_id, s.x0, s.x1, c.variable, count(*) as n, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from sg s join cur c on c.meter_id = s.meter_id and c.x between x0 and x1 where value is not null group by 1, 2, 3, 4),
      nr as (select s.meter_id, s.x0, s.x1, c.variable, c.x, c.value, c.x between x0 - 360 and x1 + 360 as near from sg s join cur c on c.meter_id = s.meter_id and (c.x < x0 or c.x > x1) where value is not null),
      ct as (select * from (select *, count_if(near) over (partition by meter_id, x0, variable) as nn from nr) where nn < 30 or near),
      cs as (select meter_id, x0, x1, variable, count(*) as n, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75, quantile_cont(value, 0.95) as q95 from ct group by 1, 2, 3, 4),
      cm as (select c.meter_id, c.x0, c.variable, 1.4826 * quantile_cont(abs(value - med), 0.5) as mad from ct c join cs on cs.meter_id = c.meter_id and cs.x0 = c.x0 and cs.variable = c.variable group by 1, 2, 3),
      ts as (select i.meter_id, i.x0, i.x1, i.n >= 3 and cs.n >= 30 and abs(i.med - cs.med) >= greatest(5 * greatest(mad, 0.15 * (q75 - q25), 1e-6), 0.025 * greatest(q95 - q05, q75 - q25, 1e-9))
        and case when i.n >= 4 then i.iqr else 0 end <= greatest(0.85 * greatest(q75 - q25, 1e-9), 3 * greatest(mad, 0.15 * (q75 - q25), 1e-6)) as ok
        from inn i join cs on cs.meter_id = i.meter_id and cs.x0 = i.x0 and cs.variable = i.variable join cm on cm.meter_id = i.meter_id and cm.x0 = i.x0 and cm.variable = i.variable),
      gd as (select meter_id, x0, x1 from ts group by 1, 2, 3 having count_if(ok) >= 2),
      lw as (select p.meter_id, x from plain_cur p join plateau_cur b on b.meter_id = p.meter_id and b.variable = p.variable where value <= lower + 1e-9 and p.meter_id not in (select meter_id from an) group by 1, 2 having count(*) = 3),
      fb as (select meter_id, x, count(*) over (partition by meter_id, isle) as n from (select *, x - row_number() over (partition by meter_id order by x) as isle from lw))
    select meter_id, x from an union select meter_id, unnest(range(x0, x1 + 1)) from gd union select meter_id, x from fb where n >= 3""",
)
add_cte(
    "sentinels",
    ("samples", "nosignal"),
    """with c as (select s.meter_id, s.variable, s.x from samples s join nosignal n on n.meter_id = s.meter_id and n.x = s.x where value is not null),
      r as (select meter_id, variable, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by meter_id, variable order by x) as isle from c) group by meter_id, variable, isle having count(*) >= 3)
    select * from c union select s.meter_id, s.variable, s.x from samples s join r on r.meter_id = s.meter_id and r.variable = s.variable and (s.x = r.x0 - 1 or s.x = r.x1 + 1) where value is not null""",
)
add_cte(
    "locked",
    ("samples", "sentinels"),
    """with b as (select s.x, s.variable, s.value is null or m.x is not null as bad from samples s left join sentinels m on m.meter_id = 1 and m.variable = s.variable and m.x = s.x where s.meter_id = 1),
      st as (select x from b where variable like 'i\\_%' escape '\\' or variable like 'p\\_%' escape '\\' group by x having bool_and(bad) filter (variable like 'i\\_%' escape '\\') or bool_and(bad) filter (variable like 'p\\_%' escape '\\'))
    select meter_id, variable, x from samples where meter_id <> 1 and value is not null and x in (select x from st)""",
)
add_cte("mask", ("sentinels", "locked"), "select * from sentinels union select * from locked")
def outlier_sql(mask: str) -> str:
    """Short extreme events of the samples outside a mask."""
    return f"""with s as (select s.meter_id, s.variable, s.x, s.value, m.x is not null as masked, d.i_an is null as gap from samples s left join {mask} m on m.meter_id = s.meter_id and m.variable = s.variable and m.x = s.x join dense d on d.meter_id = s.meter_id and d.x = s.x),
      n as (select *, max((masked or gap)::int) over (partition by meter_id, variable order by x rows between 3 preceding and 3 following) = 1 as near from s),
      r as (select *, case when not near then value end as ref from n),
      q as (select meter_id, variable, count(ref) as n, quantile_cont(ref, 0.25) as q1, quantile_cont(ref, 0.5) as med, quantile_cont(ref, 0.75) as q3 from r group by 1, 2 having count(ref) >= 30),
      g as (select r.meter_id, r.variable, any_value(q1) as q1, any_value(q3) as q3, any_value(med) as med, 1.4826 * quantile_cont(abs(ref - med), 0.5) as mad from r join q on q.meter_id = r.meter_id and q.variable = r.variable group by 1, 2),
      h as (select *, case when count(ref) over w >= 21 then quantile_cont(ref, 0.5) over w end as m1 from r window w as (partition by meter_id, variable order by x rows between 30 preceding and 30 following)),
      k as (select *, case when count(abs(ref - m1)) over w >= 21 then quantile_cont(abs(ref - m1), 0.5) over w end as m2 from h window w as (partition by meter_id, variable order by x rows between 30 preceding and 30 following)),
      z as (select k.meter_id, k.variable, k.x, k.value, greatest(q3 - q1, mad, 1e-9) as scale, m1, m2,
        case when q3 - q1 > 0 then q1 - 5 * (q3 - q1) else med - 5 * greatest(mad, 1e-9) end as lo, case when q3 - q1 > 0 then q3 + 5 * (q3 - q1) else med + 5 * greatest(mad, 1e-9) end as hi
        from k join g on g.meter_id = k.meter_id and g.variable = k.variable where value is not null and not masked),
      w as (select * from z where value < lo or value > hi or (m1 is not null and m2 is not null and abs(value - m1) / greatest(1.4826 * m2, 0.05 * scale, 1e-9) >= 8 and abs(value - m1) >= greatest(0.03 * scale, 1e-9))),
      i as (select *, x - row_number() over (partition by meter_id, variable order by x) as isle from w)
    select meter_id, variable, x, value from (select *, count(*) over (partition by meter_id, variable, isle) as run from i) where run <= 5"""


add_cte("outliers", ("samples", "mask", "dense"), outlier_sql("mask"))
add_cte("exact_cells", ("flagged",), "select meter_id, variable, x from flagged where exact")
add_cte("spikes", ("samples", "exact_cells", "dense"), outlier_sql("exact_cells"))


def floors(t: Inputs):
    return t.kept("floors", lambda: clean.global_floors(t.samples))


@query("alignment_gaps", with_tables("select meter_id, x0, x1, n from gaps where variable = 'i_an'", "gaps"))
def alignment_gaps(t: Inputs):
    return seq.runs(t.dense, ["meter_id"], F.col("i_an").isNull(), block=BLOCK)


@query("global_floor_values", with_tables("select variable, floor_value, n_floor, n_finite, second from floors", "floors"))
def global_floor_values(t: Inputs):
    return floors(t)


@query("low_plateau", with_tables("select meter_id, variable, lower from plateau", "plateau"))
def low_plateau(t: Inputs):
    return clean.low_plateau(clean.exact_floor(t.samples, floors(t)), BLOCK)


@query(
    "sentinel_mask",
    with_tables(
        """select f.meter_id, f.variable, count_if(exact) as n_exact, count_if(coalesce(value <= lower + 1e-9 and not exact, false)) as n_low, count_if(exact or coalesce(value <= lower + 1e-9, false)) as n_core
        from flagged f left join plateau p on p.meter_id = f.meter_id and p.variable = f.variable group by 1, 2""",
        "flagged", "plateau",
    ),
)
def sentinel_mask(t: Inputs):
    m = clean.sentinel_mask(t.samples, floors(t), BLOCK)
    return m.groupBy(*CH).agg(F.count_if("exact").alias("n_exact"), F.count_if("low").alias("n_low"), F.count_if("core").alias("n_core"))


def nosignal(t: Inputs):
    return t.kept("nosignal", lambda: clean.current_sentinel(t.samples, floors(t), BLOCK))


def sentinels(t: Inputs):
    return t.kept("sentinels", lambda: clean.propagate(t.samples, nosignal(t), BLOCK))


def masked(t: Inputs):
    own = sentinels(t)
    return t.kept("mask", lambda: own.unionByName(clean.main_lock(t.samples, own, 1)).distinct())


def points(t: Inputs, mask):
    gap = t.dense.select("meter_id", "x", F.col("i_an").isNull().alias("gap"))
    s = t.samples.join(gap, ["meter_id", "x"])
    return t.kept("outliers", lambda: clean.outliers(s, mask, F.col("gap"), BLOCK))


@query("sync_current_sentinel", with_tables("select meter_id, x from nosignal", "nosignal"))
def sync_current_sentinel(t: Inputs):
    return nosignal(t)


@query("propagate_sentinel", with_tables("select meter_id, variable, x from sentinels", "sentinels"))
def propagate_sentinel(t: Inputs):
    return sentinels(t)


@query("main_meter_lock", with_tables("select meter_id, variable, count(*) as n, min(x) as x0, max(x) as x1 from locked group by 1, 2", "locked"))
def main_meter_lock(t: Inputs):
    m = clean.main_lock(t.samples, sentinels(t), 1)
    return m.groupBy(*CH).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query("outliers", with_tables("select meter_id, variable, x, value from spikes", "spikes"))
def outliers(t: Inputs):
    """Against the exact placeholders only, so that the spikes of every meter are in play."""
    gap = t.dense.select("meter_id", "x", F.col("i_an").isNull().alias("gap"))
    exact = clean.exact_floor(t.samples, floors(t)).filter("exact").select(*CH, "x")
    return clean.outliers(t.samples.join(gap, ["meter_id", "x"]), exact, F.col("gap"), BLOCK)


@query(
    "apply_masks",
    with_tables(
        f"""select s.meter_id, s.variable, count(s.value) as n_value, count(case when m.x is null then s.value end) as n_no_sentinel, count(case when m.x is null and o.x is null then s.value end) as n_clean,
        {R('sum(case when m.x is null and o.x is null then s.value end)', 2)} as total from samples s left join mask m on m.meter_id = s.meter_id and m.variable = s.variable and m.x = s.x
        left join (select meter_id, variable, x from outliers) o on o.meter_id = s.meter_id and o.variable = s.variable and o.x = s.x group by 1, 2""",
        "samples", "mask", "outliers",
    ),
)
def apply_masks(t: Inputs):
    m = masked(t)
    out = clean.apply_masks(t.samples, m, points(t, m))
    return out.groupBy(*CH).agg(
        F.count("value").alias("n_value"), F.count("no_sentinel").alias("n_no_sentinel"), F.count("clean").alias("n_clean"),
        fixed(F.sum("clean"), 2).alias("total"),
    )


@query(
    "mask_tables",
    with_tables(
        f"""select variable, count(x) as n_sentinel, {R("count(x) * 100.0::double / any_value(n)")} as pct from (select s.variable, m.x, n from (select variable, count(value) as n from samples group by 1) s left join sentinels m on m.variable = s.variable) group by 1""",
        "samples", "sentinels",
    ),
)
def mask_tables(t: Inputs):
    n = t.samples.groupBy("variable").agg(F.count("value").alias("n"))
    m = sentinels(t).groupBy("variable").agg(F.count("*").alias("n_sentinel"))
    j = n.join(m, "variable", "left").na.fill(0, ["n_sentinel"])
    return j.select("variable", "n_sentinel", fixed(F.col("n_sentinel") * 100.0 / F.col("n")).alias("pct"))
