"""Window and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.functions.slopes import theil_sen
from voltloom.operators import aggregate, ranks, seq
from voltloom.operators import gaps as gap_ops
from voltloom.plans.fixture_sql import R, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK

CH = ["meter_id", "variable"]



@query(
    "longest_const_run",
    with_tables(
        """with o as (select meter_id, variable, x, round(value, 0) as v, row_number() over (partition by meter_id, variable order by x) as rn
          from samples where value is not null),
        g as (select *, rn - row_number() over (partition by meter_id, variable, v order by rn) as isle from o),
        r as (select meter_id, variable, v, isle, count(*) as n from g group by 1, 2, 3, 4)
        select meter_id, variable, max(n) as longest from r group by 1, 2""",
        "samples",
    ),
)
def longest_const_run(t: Inputs):
    known = t.samples.filter("value is not null").withColumn("v", F.round("value", 0))
    return aggregate.longest_equal_run(known, CH, "v", block=BLOCK).select(*CH, "longest")


@query(
    "dilate_mask",
    with_tables(
        """select meter_id, variable, count_if(m) as n_mask, count_if(d) as n_dilated from (select *,
        max(m::int) over (partition by meter_id, variable order by x rows between 3 preceding and 3 following) = 1 as d
        from (select *, value is null as m from samples)) group by 1, 2""",
        "samples",
    ),
)
def dilate_mask(t: Inputs):
    d = seq.dilate(t.samples.withColumn("m", F.col("value").isNull()), CH, "m", 3, "d", block=BLOCK)
    return d.groupBy(*CH).agg(F.count_if("m").alias("n_mask"), F.count_if("d").alias("n_dilated"))


@query(
    "pad_run_edges",
    with_tables(
        """select distinct s.meter_id, s.variable, s.x from samples s join gaps g on g.meter_id = s.meter_id and g.variable = s.variable
        and g.n >= 3 and (s.x = g.x0 - 1 or s.x = g.x1 + 1) where s.value is not null""",
        "samples", "gaps",
    ),
)
def pad_run_edges(t: Inputs):
    return seq.pad_edges(t.gaps, CH).join(t.samples.filter("value is not null").select(*CH, "x"), [*CH, "x"])


@query(
    "rolling_median",
    with_tables(
        f"""select meter_id, variable, x, {R('med')} as med from (select *, case when count(value) over w >= 21 then
        quantile_cont(value, 0.5) over w end as med from samples
        window w as (partition by meter_id, variable order by x rows between 30 preceding and 30 following)) where med is not null""",
        "samples",
    ),
)
def rolling_median(t: Inputs):
    return seq.rolling_median(t.samples, CH, "value", "med", block=BLOCK).filter("med is not null").select(
        *CH, "x", fixed("med").alias("med")
    )


@query(
    "infer_step",
    with_tables(
        f"""select {R('quantile_cont(dt, 0.5)', 3)} as median_step_sec, count(*) as n from (select (epoch_us(time) -
        epoch_us(lag(time) over (partition by meter_id order by time))) / 1000000.0::double as dt from readings) where dt > 0""",
        "readings",
    ),
)
def infer_step(t: Inputs):
    dt = seq.time_steps(t.readings, ["meter_id"], "time").filter("dt > 0")
    return ranks.quantiles(dt, [], "dt", {"m": 0.5}).select(fixed("m", 3).alias("median_step_sec"), "n")


@query(
    "context_stats",
    with_tables(
        f"""with seg as (select * from gaps where n >= 6),
        c as (select g.meter_id, g.variable, g.x0, count(*) as n, quantile_cont(s.value, 0.5) as med from seg g join samples s
          on s.meter_id = g.meter_id and s.variable = g.variable and (s.x between g.x0 - 48 and g.x0 - 1 or s.x between g.x1 + 1 and g.x1 + 48)
          where s.value is not null group by 1, 2, 3),
        a as (select meter_id, variable, count(*) as n, quantile_cont(value, 0.5) as med from samples where value is not null group by 1, 2)
        select g.meter_id, g.variable, g.x0, case when c.n >= 30 then c.n else a.n end as n_ctx,
          {R('case when c.n >= 30 then c.med else a.med end')} as med from seg g left join c on c.meter_id = g.meter_id
          and c.variable = g.variable and c.x0 = g.x0 join a on a.meter_id = g.meter_id and a.variable = g.variable""",
        "samples", "gaps",
    ),
)
def context_stats(t: Inputs):
    seg = t.gaps.filter("n >= 6").select(*CH, "x0", "x1")
    known = t.samples.filter("value is not null")
    near = seq.context_points(seg, CH, 48).join(known, [*CH, "x"])
    local = ranks.quantiles(near, [*CH, "x0"], "value", {"m": 0.5}).withColumnsRenamed({"n": "n1", "m": "m1"})
    whole = ranks.quantiles(known, CH, "value", {"m": 0.5}).withColumnsRenamed({"n": "n2", "m": "m2"})
    j = seg.join(local, [*CH, "x0"], "left").join(whole, CH)
    use = F.coalesce(F.col("n1"), F.lit(0)) >= 30
    return j.select(
        *CH, "x0", F.when(use, F.col("n1")).otherwise(F.col("n2")).alias("n_ctx"),
        fixed(F.when(use, F.col("m1")).otherwise(F.col("m2"))).alias("med"),
    )


@query(
    "cumulative_importance",
    with_tables(
        f"""with i as (select variable as feature, sum(abs(value)) as w from samples group by 1),
        c as (select feature, row_number() over (order by w desc, feature) as rank, count(*) over () as n,
          sum(w) over (order by w desc, feature) / sum(w) over () as cum from i)
        select feature, rank, {R('cum * 100')} as cum_pct, rank = first_value(rank) over (order by cum - (rank - 1) / (n - 1.0::double) desc, rank) as is_knee from c""",
        "samples",
    ),
)
def cumulative_importance(t: Inputs):
    imp = t.samples.groupBy(F.col("variable").alias("feature")).agg(F.sum(F.abs("value")).alias("w"))
    out = ranks.kneedle(imp, "feature", "w")
    return out.select("feature", "rank", fixed(F.col("cum") * 100).alias("cum_pct"), "is_knee")


@query(
    "cumulative_energy",
    with_tables(
        f"""select meter_id, x, {R('sum(coalesce(p_a, 0)) over (partition by meter_id order by x) / 1000.0::double')} as kwh
        from dense""",
        "dense",
    ),
)
def cumulative_energy(t: Inputs):
    d = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p"))
    out = seq.running(d, ["meter_id"], {"e": F.col("p")}, block=BLOCK)
    return out.select("meter_id", "x", fixed(F.col("e") / 1000.0).alias("kwh"))


@query(
    "sliding_windows",
    with_tables(
        f"""select meter_id, window_idx, n, {R('s')} as total, {R('a')} as first_p, {R('b')} as last_p from (select meter_id, x as window_idx,
        count(*) over w as n, sum(coalesce(p_a, 0)) over w as s, first_value(coalesce(p_a, 0)) over w as a, last_value(coalesce(p_a, 0)) over w as b
        from dense window w as (partition by meter_id order by x rows between current row and 11 following)) where n = 12""",
        "dense",
    ),
)
def sliding_windows(t: Inputs):
    d = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p"))
    win = seq.windows(d, ["meter_id"], ["p"], 12, block=BLOCK)
    total = F.aggregate(F.col("window.p"), F.lit(0.0), lambda a, b: a + b)
    return win.select(
        "meter_id", "window_idx", F.size("window").cast("long").alias("n"), fixed(total).alias("total"),
        fixed(F.col("window")[0]["p"]).alias("first_p"), fixed(F.col("window")[11]["p"]).alias("last_p"),
    )


@query("unwindow", with_tables("select meter_id, x, coalesce(p_a, 0) as p from dense", "dense"))
def unwindow(t: Inputs):
    d = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p"))
    return seq.unwindow(seq.windows(d, ["meter_id"], ["p"], 12, block=BLOCK), ["meter_id"], ["p"])


@query(
    "mid_align",
    with_tables(
        "select meter_id, x - 6 as window_idx, coalesce(p_a, 0) as p_mid from dense where x - 6 between 0 and 708", "dense"
    ),
)
def mid_align(t: Inputs):
    d = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p"))
    win = seq.windows(d, ["meter_id"], ["p"], 12, block=BLOCK)
    return win.select("meter_id", "window_idx", F.element_at("window", 12 // 2 + 1)["p"].alias("p_mid"))


@query(
    "chronological_split",
    with_tables(
        """with u as (select distinct x from gridded), o as (select x, row_number() over (order by x) - 1 as ordinal, count(*) over () as n from u)
        select x, ordinal, case when ordinal < floor(n * 0.8::double) then 'train' when ordinal < floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end as split from o""",
        "gridded",
    ),
)
def chronological_split(t: Inputs):
    instants = t.gridded.select("x").distinct()
    return seq.chronological_split(seq.ordinals(instants, block=BLOCK), instants.agg(F.count("*").alias("n_total")))


@query(
    "minmax_scale",
    with_tables(
        f"""with f as (select meter_id, variable, min(value) as lo, max(value) as hi from samples where x < (select train_end from span) group by 1, 2)
        select s.meter_id, s.variable, x, {R("(value - lo) / case when hi = lo then 1 else hi - lo end", 6)} as scaled from samples s
        join f on f.meter_id = s.meter_id and f.variable = s.variable where value is not null and lo is not null""",
        "samples", "span",
    ),
)
def minmax_scale(t: Inputs):
    known = t.samples.filter("value is not null")
    out = aggregate.minmax_scale(known, CH, "value", F.col("x") < t.train_end)
    return out.select(*CH, "x", fixed("scaled", 6).alias("scaled"))


@query(
    "frequency",
    with_tables(
        f"""with d as (select meter_id, variable, x, sign(value - lag(value) over w) as s1 from (select meter_id, variable, x, coalesce(value, 0) as value from samples)
          window w as (partition by meter_id, variable order by x)),
        e as (select meter_id, variable, s1 <> lag(s1) over (partition by meter_id, variable order by x) as turn from d)
        select meter_id, variable, {R('count_if(turn)::double / (count(*) - 2)', 6)} as freq from e group by 1, 2""",
        "samples",
    ),
)
def frequency(t: Inputs):
    s = t.samples.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return seq.direction_changes(s, CH, "value", block=BLOCK).select(*CH, fixed("freq", 6).alias("freq"))


@query(
    "detrend",
    with_tables(
        f"""with o as (select *, x - row_number() over (partition by meter_id, variable order by x) as g from samples where value is not null),
        e as (select *, min(x) over q as x0, max(x) over q as x1, first_value(value) over (partition by meter_id, variable, g order by x) as v0,
          last_value(value) over (partition by meter_id, variable, g order by x rows between unbounded preceding and unbounded following) as v1
          from o window q as (partition by meter_id, variable, g))
        select meter_id, variable, x, {R('case when x1 > x0 then value - (v0 + (v1 - v0) * (x - x0) / (x1 - x0)) else 0 end')} as dev from e""",
        "samples",
    ),
)
def detrend(t: Inputs):
    pieces = seq.runs(t.samples, CH, F.col("value").isNotNull(), block=BLOCK)
    return seq.detrend_runs(t.samples, CH, "value", pieces).select(*CH, "x", fixed("dev").alias("dev"))


def theil_sen_slopes(t: Inputs):
    win = seq.windows(t.samples.withColumn("value", F.coalesce("value", F.lit(0.0))), CH, ["value"], 24, stride=24, block=BLOCK)
    return win.select(*CH, "window_idx", fixed(theil_sen("window.value")).alias("slope"))


@query(
    "theil_sen",
    with_tables(
        f"""with o as (select meter_id, variable, x, x // 24 as g, coalesce(value, 0) as value from samples)
        select a.meter_id, a.variable, a.g * 24 as window_idx, {R('quantile_cont((b.value - a.value) / (b.x - a.x), 0.5)')} as slope
        from o a join o b on a.meter_id = b.meter_id and a.variable = b.variable and a.g = b.g and a.x < b.x group by 1, 2, 3 having count(*) = 276""",
        "samples",
    ),
)
def theil_sen_windows(t: Inputs):
    return theil_sen_slopes(t)


@query(
    "weighted_line",
    with_tables(
        f"""select meter_id, {R('(sum(w * x * p) - sum(w * x) * sum(w * p) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w))')} as slope
        from (select meter_id, x::double as x, p_a as p, 1.0::double / (1 + x) as w from gridded) group by 1""",
        "gridded",
    ),
)
def weighted_line(t: Inputs):
    d = t.dense.filter("p_a is not null")
    x = F.col("x").cast("double")
    line = seq.weighted_line(d, ["meter_id"], x, F.col("p_a"), F.lit(1.0) / (F.col("x") + 1))
    return line.select("meter_id", fixed("slope").alias("slope"))


@query(
    "interp_linear_hold",
    with_tables(
        f"""with n as (select *, max(case when value is not null then x end) over (partition by meter_id, variable order by x) as px,
          min(case when value is not null then x end) over (partition by meter_id, variable order by x rows between current row and unbounded following) as nx
          from samples)
        select n.meter_id, n.variable, n.x, {R('coalesce(n.value, a.value + (b.value - a.value) * (n.x - n.px) / nullif(n.nx - n.px, 0), a.value, b.value)')} as value
        from n left join samples a on a.meter_id = n.meter_id and a.variable = n.variable and a.x = n.px
        left join samples b on b.meter_id = n.meter_id and b.variable = n.variable and b.x = n.nx""",
        "samples",
    ),
)
def interp_linear_hold(t: Inputs):
    return seq.interpolate(t.samples, CH, "value", "filled", block=BLOCK).select(*CH, "x", fixed("filled").alias("value"))


@query(
    "resample_segment",
    with_tables(
        f"""with src as (select meter_id, variable, x - 100 as j, coalesce(value, 0) as v from samples where x between 100 and 147),
        tgt as (select meter_id, variable, x0, x1, unnest(range(x0, x1 + 1)) as x from gaps),
        p as (select *, coalesce((x - x0)::double / nullif(x1 - x0, 0), 0) * 47 as pos from tgt)
        select p.meter_id, p.variable, p.x, {R('a.v + (b.v - a.v) * (pos - floor(pos))')} as value from p
        join src a on a.meter_id = p.meter_id and a.variable = p.variable and a.j = floor(pos) join src b on b.meter_id = p.meter_id and b.variable = p.variable and b.j = least(floor(pos) + 1, 47)""",
        "samples", "gaps",
    ),
)
def resample_segment(t: Inputs):
    src = t.samples.filter("x between 100 and 147").select(*CH, (F.col("x") - 100).alias("j"), F.coalesce("value", F.lit(0.0)).alias("v"))
    return seq.stretch(src, CH, t.gaps.select(*CH, "x0", "x1"), "v", F.lit(48)).select(*CH, "x", fixed("stretched").alias("value"))


@query(
    "half_step_shift",
    with_tables(
        f"""select meter_id, x, {R('0.5 * (p + coalesce(lead(p) over w, p))')} as ahead, {R('0.5 * (coalesce(lag(p) over w, p) + p)')} as behind
        from (select meter_id, x, coalesce(p_a, 0) as p from dense) window w as (partition by meter_id order by x)""",
        "dense",
    ),
)
def half_step_shift(t: Inputs):
    d = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p"))
    cols = {
        "a": lambda w: 0.5 * (F.col("p") + F.coalesce(F.lead("p").over(w), F.col("p"))),
        "b": lambda w: 0.5 * (F.coalesce(F.lag("p").over(w), F.col("p")) + F.col("p")),
    }
    return seq.framed(d, ["meter_id"], cols, 1, 1, block=BLOCK).select(
        "meter_id", "x", fixed("a").alias("ahead"), fixed("b").alias("behind")
    )


@query(
    "gap_inventory",
    with_tables(
        f"""select s.meter_id, s.variable, n_points, n_missing, {R('n_missing * 100.0::double / n_points')} as missing_pct,
        coalesce(n_gaps, 0) as n_gaps, coalesce(longest, 0) * 60 as longest_min, n_missing * 100.0::double / n_points >= 99 as is_dead
        from (select meter_id, variable, count(*) as n_points, count_if(value is null) as n_missing from samples group by 1, 2) s
        left join (select meter_id, variable, count(*) as n_gaps, max(n) as longest from gaps group by 1, 2) g
        on g.meter_id = s.meter_id and g.variable = s.variable""",
        "samples", "gaps",
    ),
)
def gap_inventory(t: Inputs):
    inv = gap_ops.inventory(t.samples, t.gaps, CH, step_min=60)
    return inv.withColumn("missing_pct", fixed("missing_pct"))
