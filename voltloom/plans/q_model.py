"""Repair, feature ranking, importance, ablation and held-out checks of the fill."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.functions import names
from voltloom.functions.numeric import fixed
from voltloom.operators import datasets, features, fit, ranks, repair, seq, statistics
from voltloom.plans.fixture_sql import CTES, R, add_cte, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK, VARIABLES
from voltloom.streaming.windows import stream_grid

CH = ["meter_id", "variable"]
CURP = "('i_an', 'i_bn', 'i_cn', 'p_a', 'p_b', 'p_c')"

add_cte(
    "islands",
    ("samples",),
    "select meter_id, variable, min(x) as x0, max(x) as x1, count(*) as n from (select *, x - row_number() over (partition by meter_id, variable order by x) as g from samples where value is not null) group by meter_id, variable, g",
)
add_cte(
    "frag",
    ("samples", "islands"),
    """select *, n_known >= 50 and median_len <= 5 and n_islands >= 30 and missing between 0.1 and 0.95 and longest < 60 as fragmented from (select i.*, n_known, missing from
    (select meter_id, variable, count(*) as n_islands, quantile_cont(n, 0.5) as median_len, max(n) as longest from islands group by 1, 2) i
    join (select meter_id, variable, count(value) as n_known, count_if(value is null)::double / count(*) as missing from samples group by 1, 2) m on m.meter_id = i.meter_id and m.variable = i.variable)""",
)
# meter 7, the twin of meter 6, without every fourth step: a fragmented channel with a donor
add_cte("broken", ("samples",), "select meter_id, variable, x, case when meter_id = 7 and x % 4 = 0 then null else value end as value from samples")
add_cte("broken_islands", ("broken",), CTES["islands"][1].replace("from samples", "from broken"))
add_cte("broken_frag", ("broken", "broken_islands"), CTES["frag"][1].replace("from islands", "from broken_islands").replace("from samples", "from broken"))
add_cte(
    "donors",
    ("broken", "broken_frag"),
    """select *, row_number() over (partition by meter_id, variable order by round(abs(r), 9) desc, donor desc) as rank from (
    select a.meter_id, a.variable, b.meter_id as donor, count(*) as n, corr(a.value, b.value) as r, regr_slope(a.value, b.value) as sl, regr_intercept(a.value, b.value) as ic, stddev_pop(a.value) as s1, stddev_pop(b.value) as s2
    from broken a join broken_frag f on f.meter_id = a.meter_id and f.variable = a.variable and f.fragmented join broken b on b.variable = a.variable and b.x = a.x and b.meter_id <> a.meter_id
    join (select meter_id, variable from broken_frag where missing <= 0.45) c on c.meter_id = b.meter_id and c.variable = b.variable where a.value is not null and b.value is not null group by 1, 2, 3)
    where n >= 100 and s1 >= 1e-9 and s2 >= 1e-9 and abs(r) >= 0.5""",
)
# every pair with enough common readings, whether or not its correlation reaches the gate
add_cte("donor_pairs", CTES["donors"][0], CTES["donors"][1].replace(" and abs(r) >= 0.5", ""))
add_cte(
    "envelope",
    ("samples",),
    "select meter_id, variable, n_known, lo - sd as lower, hi + sd as upper from (select meter_id, variable, count(*) as n, count(value) as n_known, min(value) as lo, max(value) as hi, coalesce(stddev_samp(value), 0) as sd from samples where x between 100 and 160 group by 1, 2) where n_known >= greatest(3, ceil(n * 0.45))",
)
add_cte(
    "segments",
    ("samples", "envelope"),
    """with bad as (select s.meter_id, s.variable, s.x from samples s join envelope e on e.meter_id = s.meter_id and e.variable = s.variable where value < lower or value > upper),
      ea as (select meter_id, variable, min(x) as x0, max(x) as x1 from bad where x <= 700 group by 1, 2 having count(*) >= 30 and max(x) - min(x) + 1 >= 60),
      rest as (select b.* from bad b left join ea on ea.meter_id = b.meter_id and ea.variable = b.variable where ea.x0 is null or b.x < ea.x0 or b.x > ea.x1),
      o as (select *, case when x - lag(x) over (partition by meter_id, variable order by x) - 1 <= 10 then 0 else 1 end as nw from rest),
      g as (select meter_id, variable, min(x) as x0, max(x) as x1 from (select *, sum(nw) over (partition by meter_id, variable order by x) as k from o) group by meter_id, variable, k)
    select meter_id, variable, x0, x1, 'replace' as action, 'startup' as reason from ea union all select meter_id, variable, x0, x1, case when x1 = x0 then 'clip' else 'replace' end, case when x1 = x0 then 'point' else 'block' end from g""",
)


add_cte(
    "cascade",
    ("broken", "donors"),
    """select h.meter_id, h.variable, h.x, k.donor, sl * s.value + ic as recon from broken h join donors k on k.meter_id = h.meter_id and k.variable = h.variable
      join broken s on s.meter_id = k.donor and s.variable = h.variable and s.x = h.x and s.value is not null
      join broken m on m.meter_id = 1 and m.variable = h.variable and m.x = h.x and m.value is not null where h.value is null
      qualify row_number() over (partition by h.meter_id, h.variable, h.x order by k.rank) = 1""",
)
add_cte(
    "defrag_cells",
    ("broken", "broken_frag", "donors", "cascade"),
    """select s.meter_id, s.variable, s.x, s.value as observed, coalesce(s.value, c.recon) as value, d.meter_id is not null as helped from broken s
      join broken_frag f on f.meter_id = s.meter_id and f.variable = s.variable and f.fragmented left join (select distinct meter_id, variable from donors) d on d.meter_id = s.meter_id and d.variable = s.variable
      left join cascade c on c.meter_id = s.meter_id and c.variable = s.variable and c.x = s.x""",
)
add_cte("defrag_now", ("defrag_cells",), "select meter_id, variable, x, value from defrag_cells where helped")
add_cte(
    "defrag_holes",
    ("defrag_now", "broken"),
    """select meter_id, variable, min(x) as x0, max(x) as x1 from (select n.*, n.x - row_number() over (partition by n.meter_id, n.variable order by n.x) as g from defrag_now n
      join broken m on m.meter_id = 1 and m.variable = n.variable and m.x = n.x and m.value is not null where n.value is null) group by meter_id, variable, g""",
)
add_cte("wide_gaps", ("gaps",), "select meter_id, variable, x0, x1 from gaps where n >= 3")


def _islands(name: str, cells: str, holes: str, bare: bool) -> None:
    """Overlap-add of drawn islands over holes; ``bare`` holes of channels without islands are kept at their level."""
    on = lambda a, b: f"{a}.meter_id = {b}.meter_id and {a}.variable = {b}.variable"
    add_cte(
        name,
        (cells, holes),
        f"""with isl as (select *, row_number() over (partition by meter_id, variable order by i0) - 1 as no, count(*) over (partition by meter_id, variable) as total from (
        select meter_id, variable, min(x) as i0, count(*) as k, median(value) as mid from (select *, x - row_number() over (partition by meter_id, variable order by x) as g from {cells} where value is not null) group by meter_id, variable, g having count(*) >= 8)),
      gap as (select h.*, t.total, x1 - x0 + 1 as len from {holes} h {'left ' if bare else ''}join (select distinct meter_id, variable, total from isl) t on {on('t', 'h')}),
      draw as (select g.*, c, {statistics.mixed_sql('42', 'g.meter_id', statistics.text_code_sql('g.variable'), 'g.x0', 'c')} % total as no from (select *, unnest(range(ceil(len / 4.0::double)::bigint + 1)) as c from gap where total > 0) g),
      put as (select d.*, i.i0, i.k, i.mid, sum(greatest(1, floor(i.k * 0.6::double))) over (partition by d.meter_id, d.variable, d.x0 order by c) - greatest(1, floor(i.k * 0.6::double)) as pos from draw d join isl i on {on('i', 'd')} and i.no = d.no),
      laid as (select p.*, s.x - i0 as j, s.value - mid as d, (p.x0 + pos + s.x - i0)::bigint as x from put p join {cells} s on {on('s', 'p')} and s.x between i0 and i0 + k - 1 where pos < len),
      shape as (select meter_id, variable, x0, x, sum(h * d) as a, sum(h) as w from (select *, 0.5 - 0.5 * cos(2 * pi() * j / (k - 1)) as h from laid where x <= x1) group by 1, 2, 3, 4),
      near as (select g.meter_id, g.variable, g.x0, median(s.value) as level from gap g join {cells} s on {on('s', 'g')} and (s.x between g.x0 - 60 and g.x0 - 1 or s.x between g.x1 + 1 and g.x1 + 60) where s.value is not null group by 1, 2, 3)
      select e.meter_id, e.variable, e.x, coalesce(a / case when w < 1e-9 then 1 else w end, 0) + coalesce(level, 0) as value from (select *, unnest(range(x0, x1 + 1)) as x from gap) e
      left join shape s on {on('s', 'e')} and s.x0 = e.x0 and s.x = e.x left join near n on {on('n', 'e')} and n.x0 = e.x0""",
    )


_islands("laid_islands", "samples", "wide_gaps", True)
_islands("laid_rest", "defrag_now", "defrag_holes", False)


def fragged(t: Inputs):
    return t.kept("fragmented", lambda: repair.fragmented_series(t.samples, BLOCK))


@query("fragmented_series", with_tables(f"select meter_id, variable, n_islands, {R('median_len')} as median_len, longest, {R('missing', 6)} as missing, fragmented from frag", "frag"))
def fragmented_series(t: Inputs):
    return fragged(t).select(*CH, "n_islands", fixed("median_len").alias("median_len"), "longest", fixed("missing", 6).alias("missing"), "fragmented")


def broken(t: Inputs):
    """Samples in which meter 7, the twin of meter 6, has lost every fourth step."""
    return t.samples.withColumn("value", F.when((F.col("meter_id") != 7) | (F.col("x") % 4 != 0), F.col("value")))


def donor_pairs(t: Inputs):
    frag = t.kept("broken_fragmented", lambda: repair.fragmented_series(broken(t), BLOCK).filter("fragmented").select(*CH))
    return t.kept("donor_pairs", lambda: repair.donor_ranking(broken(t), frag, BLOCK, 0.0))


def donors(t: Inputs):
    return donor_pairs(t).filter(F.abs("r") >= repair.RULES.donor_corr)


@query("donor_ranking", with_tables(f"select meter_id, variable, donor, n, {R('r', 6)} as r, rank, abs(r) >= 0.5 as accepted from donor_pairs", "donor_pairs"))
def donor_ranking(t: Inputs):
    """All pairs in the order of their correlation; the gate only marks those that may give values."""
    return donor_pairs(t).select(*CH, "donor", "n", fixed("r", 6).alias("r"), "rank", (F.abs("r") >= repair.RULES.donor_corr).alias("accepted"))


@query(
    "donor_cascade",
    with_tables(
        f"select meter_id, variable, x, donor, {R('recon', 3)} as recon from cascade",
        "cascade",
    ),
)
def donor_cascade(t: Inputs):
    return repair.donor_cascade(broken(t), donors(t), 1, BLOCK).select(*CH, "x", "donor", fixed("recon", 3).alias("recon"))


def envelope(t: Inputs):
    return t.kept("envelope", lambda: repair.reference_envelope(t.samples, 100, 160))


@query("reference_envelope", with_tables(f"select meter_id, variable, n_known, {R('lower')} as lower, {R('upper')} as upper from envelope", "envelope"))
def reference_envelope(t: Inputs):
    return envelope(t).select(*CH, "n_known", fixed("lower").alias("lower"), fixed("upper").alias("upper"))


@query("repair_segments", with_tables("select * from segments", "segments"))
def repair_segments(t: Inputs):
    return repair.repair_segments(t.samples, envelope(t), BLOCK)


@query("repair_summary", with_tables("select action, reason, regexp_extract(variable, '^(hrm_[iv]|thd[iv]|cos|[ivpqs])_', 1) as family, count(*) as n_blocks, sum(x1 - x0 + 1)::bigint as n_points from segments group by 1, 2, 3", "segments"))
def repair_summary(t: Inputs):
    s = repair.repair_segments(t.samples, envelope(t), BLOCK)
    return s.groupBy("action", "reason", names.family_of("variable").alias("family")).agg(
        F.count("*").alias("n_blocks"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n_points")
    )


@query("apply_repair")
def apply_repair(t: Inputs):
    return repair.apply_repair(t.samples, envelope(t), 100, 160, t.steps - 1, BLOCK)


# ---- features -------------------------------------------------------------------------------------


def design(t: Inputs):
    """Main meter quantities beside every target, with the time segment of each row."""
    x = t.dense.filter("meter_id = 1").drop("meter_id")
    seg = F.floor(F.col("x") / (t.steps // 6)).cast("int")
    return t.truth.select("output", "x", "y").join(x, "x").withColumn("seg", seg)


def ranking(t: Inputs):
    return t.kept("ranking", lambda: features.recursive_ranking(features.gram(design(t), VARIABLES, "y"), VARIABLES))


@query("recursive_feature_ranking")
def recursive_feature_ranking(t: Inputs):
    return ranking(t)


@query("global_importance")
def global_importance(t: Inputs):
    return features.global_importance(ranking(t))


@query("candidate_sets")
def candidate_sets(t: Inputs):
    imp = features.global_importance(ranking(t))
    return features.candidate_sets(imp, ranks.kneedle(imp.select("feature", "weight"), "feature", "weight"), 12)


@query("family_ablation")
def family_ablation(t: Inputs):
    base = [v for v in VARIABLES if v.startswith(("v_", "i_"))]
    configs = {
        "base": base, "add_thd": base + [v for v in VARIABLES if v.startswith("thd")],
        "drop_voltage": [v for v in base if v.startswith("i_")], "all": list(VARIABLES),
    }
    return features.family_ablation(design(t), VARIABLES, "y", configs, 5)


@query(
    "partition_audit",
    with_tables("select family, count(distinct variable) as n_features, count(*) filter (family = '') as n_orphan from (select variable, regexp_extract(variable, '^(hrm_[iv]|thd[iv]|cos|[ivpqs])_', 1) as family from samples) group by 1", "samples"),
)
def partition_audit(t: Inputs):
    fam = names.family_of("variable")
    return t.samples.groupBy(fam.alias("family")).agg(
        F.count_distinct("variable").alias("n_features"), F.count_if(fam == "meta").alias("n_orphan")
    )


FACTORS = [f"{c}_{p}{n}" for p in "abc" for c, n in (("v", "n"), ("i", "n"), ("cos", ""))]
FAMILIES = {"voltage": [f"v_{p}n" for p in "abc"], "current": [f"i_{p}n" for p in "abc"], "cosine": [f"cos_{p}" for p in "abc"], "load": [c for c in FACTORS if c[0] != "v"]}


def _perm_sql(groups: dict[str, list[str]], more: str) -> str:
    """Importance of groups for the model ``v * i * cos`` of every meter and phase; the shuffle is the bijection of ordinals."""
    known = ", ".join(f"coalesce({c}, 0) as {c}" for c in [*FACTORS, "p_a", "p_b", "p_c"])
    model = lambda cols: " + ".join("(" + " * ".join(f"{'s' if c in cols else 'b'}.{c}" for c in (f"v_{p}n", f"i_{p}n", f"cos_{p}")) + ")" for p in "abc")
    sums = ", ".join(f"sum({model(cols)})" for cols in groups.values())
    return f"""with b as (select meter_id, {known}, row_number() over (partition by meter_id order by x) - 1 as o, count(*) over (partition by meter_id) as n from gridded),
      j as (select rep, sum(b.p_a + b.p_b + b.p_c) as y, sum({model([])}) as plain, unnest({list(groups)}) as grp, unnest([{sums}]) as s
        from (select unnest(range(5)) as rep), b join b s on s.meter_id = b.meter_id and s.o = (b.o * case when b.n % 7919 = 0 then 104729 else 7919 end + 1299709 * (rep + 1)) % b.n group by rep),
      d as (select grp, (abs(s - y) - abs(plain - y)) / abs(y) * 100 as d from j), i as (select grp, avg(d) as importance, stddev_samp(d) as sd from d group by 1) {more}"""


def importance(t: Inputs, groups: dict[str, list[str]]):
    def rows():
        columns = [*FACTORS, "p_a", "p_b", "p_c"]
        known = t.gridded.select("meter_id", "x", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
        total = known.groupBy("meter_id").agg(F.count("*").alias("n_all"))
        return seq.running(known, ["meter_id"], {"no": F.lit(1)}, block=BLOCK).withColumn("ordinal", F.col("no") - 1).drop("no").join(total, "meter_id")

    predict = {p: lambda get, p=p: get(f"v_{p}n") * get(f"i_{p}n") * get(f"cos_{p}") for p in "abc"}
    return statistics.permutation_importance(t.kept("perm_rows", rows), ["meter_id"], groups, predict, {p: f"p_{p}" for p in "abc"}, 5)


@query("permutation_importance", with_tables(_perm_sql({c: [c] for c in FACTORS}, f"select grp, {R('importance')} as importance, {R('sd')} as sd from i"), "gridded"))
def permutation_importance(t: Inputs):
    return importance(t, {c: [c] for c in FACTORS}).select("grp", fixed("importance").alias("importance"), fixed("sd").alias("sd"))


@query("grouped_permutation_importance", with_tables(_perm_sql(FAMILIES, f"select grp, {R('importance')} as importance, {R('sd')} as sd from i"), "gridded"))
def grouped_permutation_importance(t: Inputs):
    return importance(t, FAMILIES).select("grp", fixed("importance").alias("importance"), fixed("sd").alias("sd"))


@query(
    "importance_top",
    with_tables(
        _perm_sql({c: [c] for c in FACTORS}, f", r as (select *, row_number() over (order by {R('importance')} desc, grp) as rank from i) select rank, grp as feature, {R('importance')} as importance, {R('100 * greatest(importance, 0) / nullif((select sum(greatest(importance, 0)) from i), 0)')} as share_pct from r where rank <= 15"),
        "gridded",
    ),
)
def importance_top(t: Inputs):
    """The fifteen features that matter most, and their share of all that matters."""
    i = importance(t, {c: [c] for c in FACTORS})
    top = Window.partitionBy().orderBy(F.desc(fixed("importance")), "grp")  # one row a feature
    whole = F.nullif(F.sum(F.greatest("importance", F.lit(0.0))).over(Window.partitionBy()), F.lit(0.0))
    ranked = i.select(F.row_number().over(top).alias("rank"), F.col("grp").alias("feature"), fixed("importance").alias("importance"), fixed(100 * F.greatest("importance", F.lit(0.0)) / whole).alias("share_pct"))
    return ranked.filter("rank <= 15")


# ---- stream extension on a table ---------------------------------------------------------------------


@query(
    "stream_grid",
    with_tables(f"select meter_id, date_trunc('hour', time) as start, count(*) as n, {R('avg(coalesce(p_a, 0))')} as p_a, {R('avg(coalesce(p_a, 0)) / 1000.0::double')} as kwh from readings group by 1, 2", "readings"),
)
def stream_grid_batch(t: Inputs):
    s = stream_grid(t.readings, ["p_a"], "1 hour", "1 hour", "p_a")
    return s.select("meter_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", fixed("p_a").alias("p_a"), fixed("kwh").alias("kwh"))


# ---- physical fit, island overlap-add, split windows --------------------------------------------------


@query(
    "relative_residuals",
    with_tables(
        f"""with z as (select meter_id, unnest(['A', 'B', 'C']) as phase, unnest([v_an, v_bn, v_cn]) as v, unnest([i_an, i_bn, i_cn]) as i, unnest([p_a, p_b, p_c]) as p, unnest([q_a, q_b, q_c]) as q, unnest([s_a, s_b, s_c]) as s, unnest([cos_a, cos_b, cos_c]) as c from gridded)
        select meter_id, phase, {R('quantile_cont(abs((s - v * i) / (abs(s) + 1e-9)), 0.5)', 5)} as vi, {R('quantile_cont(abs((p - s * c) / (abs(p) + 1e-9)), 0.5)', 5)} as pcos, {R('quantile_cont(abs((s * s - p * p - q * q) / (s * s + 1e-9)), 0.5)', 5)} as tri from z where s > 0 group by 1, 2""",
        "gridded",
    ),
)
def relative_residuals(t: Inputs):
    rows = fit.usable(t.dense.filter("p_a is not null"))
    m = fit.median_residuals(rows, {n: F.lit(v) for n, v in zip(fit.NAMES, fit.START)})
    return m.select("meter_id", "phase", *[fixed(c, 5).alias(c) for c in ("vi", "pcos", "tri")])


@query("physical_fit")
def physical_fit(t: Inputs):
    return t.kept("physical_fit", lambda: fit.physical_fit(t.dense.filter("p_a is not null")))


@query("island_overlap_add", with_tables(f"select meter_id, variable, x, {R('value')} as value from laid_islands", "laid_islands"))
def island_overlap_add(t: Inputs):
    got = repair.island_overlap_add(t.samples, t.gaps.filter("n >= 3").select(*CH, "x0", "x1"), BLOCK)
    return got.select(*CH, "x", fixed("value").alias("value"))


@query(
    "defragment",
    with_tables(
        f"""select c.meter_id, c.variable, c.x, {R('coalesce(value, l.laid)')} as value, case when observed is not null then 'observed' when value is not null then 'donor' when l.laid is not null then 'islands'
        when helped then 'none' else 'no_donor' end as origin from defrag_cells c left join (select meter_id, variable, x, value as laid from laid_rest) l on l.meter_id = c.meter_id and l.variable = c.variable and l.x = c.x""",
        "defrag_cells", "laid_rest",
    ),
)
def defragment(t: Inputs):
    return repair.defragment(broken(t), 1, BLOCK).withColumn("value", fixed("value"))


@query(
    "split_windows",
    with_tables(
        f"""with c as (select meter_id, variable, x, coalesce(value, 0) as v from samples), f as (select meter_id, variable, min(v) as lo, max(v) as hi from c where x < (select train_end from span) group by 1, 2),
        s as (select c.meter_id, c.variable, x, case when x < (select train_end from span) then 'train' when x < (select valid_end from span) then 'val' else 'test' end as split, (v - lo) / case when hi = lo then 1 else hi - lo end as v from c join f on f.meter_id = c.meter_id and f.variable = c.variable)
        select meter_id, variable, split, x as window_idx, {R('total', 5)} as total from (select *, count(*) over w as n, sum(v) over w as total from s window w as (partition by meter_id, variable, split order by x rows between current row and 11 following)) where n = 12""",
        "samples", "span",
    ),
)
def split_windows(t: Inputs):
    rows = t.samples.select(*CH, "x", F.coalesce("value", F.lit(0.0)).alias("v"))
    w = datasets.split_windows(rows, CH, ["v"], F.col("x") < t.train_end, t.split(), 12, BLOCK)
    return w.select(*CH, "split", "window_idx", fixed(F.aggregate(F.col("window.v"), F.lit(0.0), lambda a, b: a + b), 5).alias("total"))
