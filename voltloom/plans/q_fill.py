"""Gap filling. Drawn fragments have no SQL twin; they are tested by properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.operators import fill, seq
from voltloom.operators.statistics import PRIME, mixed_sql, text_code_sql
from voltloom.plans.fixture_sql import R, add_cte, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK

CH = ["meter_id", "variable"]
#: Share of the admissible windows that are hidden, by a hash of each.
SHARE = 0.05
#: Steps of the windows of the held-out proof.
SIZES = (3, 6, 12, 24)
# fixed values: hours per category of the hourly grid and its portions
BANDS = [(1, 1, 6, 1), (2, 7, 12, 2), (3, 13, 24, 3), (4, 25, None, 4)]

add_cte(
    "bordered",
    ("samples", "gaps"),
    "select g.*, a.value as vb, b.value as va from gaps g left join samples a on a.meter_id = g.meter_id and a.variable = g.variable and a.x = g.x0 - 1"
    " left join samples b on b.meter_id = g.meter_id and b.variable = g.variable and b.x = g.x1 + 1",
)
add_cte(
    "micro",
    ("samples", "bordered"),
    "select s.meter_id, s.variable, s.x, coalesce(s.value, g.vb + (g.va - g.vb) * (s.x - g.x0 + 1) / (g.n + 1)) as value, case when s.value is not null then 'obs' when g.n is not null then 'micro' end as origin"
    " from samples s left join bordered g on g.meter_id = s.meter_id and g.variable = s.variable and s.x between g.x0 and g.x1 and g.n <= 2 and g.vb is not null and g.va is not null",
)
from voltloom.plans import fill_sql  # noqa: E402, F401 - its tables build on the two above


def known(t: Inputs):
    return t.kept("micro", lambda: fill.micro_fill(t.samples, fill.bordered_gaps(t.samples, BLOCK)))


@query("micro_gap_fill", with_tables(f"select meter_id, variable, x, {R('value')} as value from micro where origin = 'micro'", "micro"))
def micro_gap_fill(t: Inputs):
    return known(t).filter("origin = 'micro'").select(*CH, "x", fixed("value").alias("value"))


@query(
    "fragment_library",
    with_tables("select meter_id, variable, min(x) as x0, max(x) as x1, count(*) as n from (select *, x - row_number() over (partition by meter_id, variable order by x) as g from micro where value is not null) group by meter_id, variable, g having count(*) >= 3", "micro"),
)
def fragment_library(t: Inputs):
    return fill.fragment_library(known(t), BLOCK)


@query(
    "portions",
    with_tables(
        "select meter_id, variable, x0, n, greatest(case when n <= 6 then 1 when n <= 12 then 2 when n <= 24 then 3 else 4 end, case when n > 360 then ceil(n / 120.0) else 0 end)::int as portions,"
        " greatest(3, ceil(n / greatest(case when n <= 6 then 1 when n <= 12 then 2 when n <= 24 then 3 else 4 end, case when n > 360 then ceil(n / 120.0) else 0 end)::double))::bigint as plen from gaps",
        "gaps",
    ),
)
def portions(t: Inputs):
    return fill.portions(t.gaps, BANDS).select(*CH, "x0", "n", "portions", "plen")


def plan(t: Inputs):
    if "plan" not in t.__dict__:
        t.plan = fill.fill_plan(t.samples, BANDS, BLOCK)
    return t.plan


@query("gap_supported", with_tables("select meter_id, variable, x0, n, plen, cap, supported from params", "params"))
def gap_supported(t: Inputs):
    return plan(t)["params"].select(*CH, "x0", "n", "plen", "cap", "supported")


@query("gap_flags", with_tables(f"select meter_id, variable, x0, n, {R('mad')} as mad, edge_risk, regime, low_conf from flags", "flags"))
def gap_flags(t: Inputs):
    p = plan(t)["params"]
    mad = F.greatest(F.coalesce("shape.mad", F.lit(0.0)), "mad_series", F.lit(fill.RULES.tiny))
    return p.select(*CH, "x0", "n", fixed(mad).alias("mad"), "edge_risk", "regime", "low_conf")


@query("series_texture", with_tables(f"select meter_id, variable, {R('s_amp')} as s_amp, {R('s_freq')} as s_freq from textures", "textures"))
def series_texture(t: Inputs):
    p = plan(t)
    s = fill.series_texture(p["library"], p["blocks"], 42, BLOCK)
    return s.select(*CH, fixed("s_amp").alias("s_amp"), fixed("s_freq").alias("s_freq"))


@query("pick_fragment", with_tables("select meter_id, variable, x0, pos, len, start, cost from picks", "picks"))
def pick_fragment(t: Inputs):
    return plan(t)["picks"].select(*CH, "x0", "pos", "len", "start", "cost")


@query("texture", with_tables(f"select meter_id, variable, x0, o, {R('tex')} as tex from laid", "laid"))
def texture(t: Inputs):
    return plan(t)["texture"].select(*CH, "x0", "o", fixed("tex").alias("tex"))


@query("backbone", with_tables(f"select meter_id, variable, x0, x, {R('base')} as base from levels", "levels"))
def backbone(t: Inputs):
    return fill.level_curve(plan(t)["params"]).select(*CH, "x0", "x", fixed("base").alias("base"))


@query("edge_fill", with_tables(f"select meter_id, variable, x0, x, rich, {R('cand')} as cand from edges", "edges"))
def edge_fill(t: Inputs):
    p = plan(t)
    e = fill.edge_points(p["gaps"], p["known"], BLOCK)
    return e.select(*CH, "x0", "x", (F.col("kind") == "analog").alias("rich"), fixed("cand").alias("cand"))


@query("range_guard", with_tables(f"select meter_id, variable, x0, x, {R('y')} as y, {R('scale')} as scale, clipped from made", "made"))
def range_guard(t: Inputs):
    return fill.fill_points(plan(t)).select(*CH, "x0", "x", fixed("y").alias("y"), fixed("scale").alias("scale"), "clipped")


def filled(t: Inputs):
    return t.kept("analog", lambda: fill.filled_cells(t.samples, plan(t), fill.fill_points(plan(t))))


@query("analog_fill", with_tables(f"select meter_id, variable, x, observed, {R('value')} as value, code, kind, rescaled, clipped, edge_risk, regime, low_conf from refilled", "refilled"))
def analog_fill(t: Inputs):
    return filled(t).withColumn("value", fixed("value"))


@query(
    "fill_trace",
    with_tables(
        "select meter_id, variable, " + ", ".join(f"count_if(kind = '{k}') as n_{k}" for k in ("observed", "analog", "interp", "edge", "unsupported", "unfilled"))
        + ", " + ", ".join(f"count_if({c}) as n_{c}" for c in ("rescaled", "clipped", "edge_risk", "regime", "low_conf")) + " from refilled group by 1, 2",
        "refilled",
    ),
)
def fill_trace(t: Inputs):
    return fill.fill_trace(filled(t))


def hidden(t: Inputs):
    return t.kept("hidden", lambda: fill.heldout_windows(t.samples, SIZES, SHARE, 7))


@query(
    "heldout_windows",
    with_tables(
        f"""with known as (select meter_id, variable, x, size from samples, (select unnest({list(SIZES)}) as size) where value is not null),
        w as (select size, meter_id, variable, x // size * size as x0, x // size * size + size - 1 as x1, count(*) as n_obs from known where x // size % 2 = 1 group by 1, 2, 3, 4, 5 having count(*) >= 0.5 * size)
        select w.size, w.meter_id, w.variable, w.x0, w.x1, w.n_obs from w join known l on l.size = w.size and l.meter_id = w.meter_id and l.variable = w.variable and l.x = x0 - 1
        join known r on r.size = w.size and r.meter_id = w.meter_id and r.variable = w.variable and r.x = x1 + 1
        where {mixed_sql('7', 'w.size', 'w.meter_id', text_code_sql('w.variable'), 'x0')} < {int(SHARE * PRIME)}""",
        "samples",
    ),
)
def heldout_windows(t: Inputs):
    return hidden(t)


def scores(t: Inputs):
    def build():
        win = hidden(t)
        masked = t.kept("masked_samples", lambda: fill.hide(t.samples, win))
        line = seq.interpolate(masked, CH, "value", "f", block=BLOCK).select(*CH, "x", F.col("f").alias("value"))
        own = t.kept("heldout_filled", lambda: fill.analog_fill(masked, BANDS, BLOCK))
        return fill.fill_scores(t.samples, line, win, "linear").unionByName(fill.fill_scores(t.samples, own, win, "analog"))

    return t.kept("fill_scores", build)


@query("fill_scores")
def fill_scores(t: Inputs):
    return scores(t)


@query("fill_score_summary")
def fill_score_summary(t: Inputs):
    return fill.score_summary(scores(t))


@query("fill_method_tests")
def fill_method_tests(t: Inputs):
    return fill.method_tests(scores(t), "analog", "linear")
