"""The parts of the gap fill as SQL tables; lists stand for stretches of a series."""

from __future__ import annotations

from voltloom.functions.scalars import GAIN, GAIN_LENGTH
from voltloom.operators.fill import RULES as r
from voltloom.operators.statistics import mixed_sql, text_code_sql
from voltloom.plans.fixture_sql import R, add_cte

CHAN = "meter_id, variable"


def slopes(v: str) -> str:
    """Median of the slopes of all pairs of a list."""
    return (
        f"case when len({v}) < 2 then 0::double else list_median(flatten(list_transform(range(1, len({v})), lambda i: list_transform(range(i + 1, len({v}) + 1),"
        f" lambda j: ({v}[j] - {v}[i]) / (j - i))))) end"
    )


def off_chord(v: str) -> str:
    """Deviations of a list from its chord."""
    return (
        f"case when len({v}) < 2 then list_transform({v}, lambda e: 0::double) else list_transform(range(1, len({v}) + 1),"
        f" lambda i: {v}[i] - case when i = len({v}) then {v}[len({v})] else (i - 1) * (({v}[len({v})] - {v}[1]) / (len({v}) - 1)) + {v}[1] end) end"
    )


def turns(d: str) -> str:
    """Share of the inner points of a list where its direction changes."""
    inner = f"list_filter(range(2, len({d})), lambda i: sign({d}[i + 1] - {d}[i]) <> sign({d}[i] - {d}[i - 1]))"
    return f"case when len({d}) < 3 then 0::double else len({inner})::double / (len({d}) - 2) end"


def spread(v: str, m: str) -> str:
    return f"(1.4826 * list_median(list_transform({v}, lambda e: abs(e - {m}))) + 1e-9)"


def smooth(z: str) -> str:
    c = f"least(greatest({z}, 0), 1)"
    return f"({c} * {c} * (3 - 2 * {c}))"


def same(a: str, b: str, *more: str) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in ("meter_id", "variable", *more))


gain = "case when n <= 60 then 1.16 " + " ".join(
    f"when n <= {b:g} then {g} + {h - g} * (ln(n) - ln({a:g})) / (ln({b:g}) - ln({a:g}))" for a, b, g, h in zip(GAIN_LENGTH, GAIN_LENGTH[1:], GAIN, GAIN[1:])
) + f" else {GAIN[-1]} end"
long = r.texture_length

add_cte(
    "alive",
    ("samples",),
    f"""select {CHAN}, mad_series, lo - m as lo, hi + m as hi from (select *, {r.margin} * greatest(hi - lo, sd, 1e-9) as m from (
      select {CHAN}, count(value) as n_obs, min(value) as lo, max(value) as hi, stddev_pop(value) as sd, 1.4826 * mad(value) as mad_series from samples group by 1, 2) where n_obs >= {r.min_obs})""",
)
add_cte(
    "mgaps",
    ("micro", "alive"),
    f"""select g.*, a.value as vb, b.value as va, case when n <= 6 then 1 when n <= 12 then 2 when n <= 24 then 3 else 4 end as category, greatest({r.min_fragment}, ceil(n / k))::bigint as plen from (
      select *, greatest(case when n <= 6 then 1 when n <= 12 then 2 when n <= 24 then 3 else 4 end, case when n > 360 then ceil(n / 120.0) else 0 end)::double as k from (
      select {CHAN}, min(x) as x0, max(x) as x1, count(*) as n from (select m.*, x - row_number() over (partition by m.meter_id, m.variable order by x) as g from micro m join alive l on {same('l', 'm')} where value is null) group by {CHAN}, g)) g
      left join micro a on {same('a', 'g')} and a.x = g.x0 - 1 left join micro b on {same('b', 'g')} and b.x = g.x1 + 1""",
)
add_cte("series", ("micro", "alive"), f"select m.meter_id, m.variable, list(value order by x) as v, list(coalesce(origin = 'obs', false) order by x) as seen from micro m join alive l on {same('l', 'm')} group by 1, 2")
add_cte(
    "library",
    ("micro",),
    f"select {CHAN}, min(x) as x0, max(x) as x1, count(*) as n from (select *, x - row_number() over (partition by {CHAN} order by x) as g from micro where value is not null) group by {CHAN}, g having count(*) >= {r.min_fragment}",
)
# the half-step scan is a fold over the steps of a run that carries the next step asked for
add_cte(
    "capacity",
    ("mgaps", "series", "library"),
    f"""select {CHAN}, plen, sum(cap)::bigint as cap from (select l.meter_id, l.variable, p.plen, list_reduce([{{'p': l.x0, 'good': 0::bigint}}] || list_transform(range(l.x0, l.x1 - p.plen + 2), lambda q:
      {{'p': q, 'good': (len(list_filter(s.seen[q + 1:q + p.plen], lambda e: e)) >= {r.support_share} * p.plen)::bigint}}),
      lambda a, e: case when e.p <> a.p then a when e.good = 1 then {{'p': e.p + p.plen, 'good': a.good + 1}} else {{'p': e.p + greatest(1, p.plen // 2), 'good': a.good}} end).good as cap
      from library l join (select distinct {CHAN}, plen from mgaps where vb is not null and va is not null) p on {same('p', 'l')} and l.n >= p.plen join series s on {same('s', 'l')}) group by 1, 2, 3""",
)
add_cte(
    "context",
    ("mgaps", "series"),
    f"""select * exclude (wl, wr), list_filter(wl, lambda e: e is not null) as l, list_filter(wr, lambda e: e is not null) as r, list_filter(wl[greatest(len(wl) - {r.near - 1}, 1):len(wl)], lambda e: e is not null) as nl, list_filter(wr[1:{r.near}], lambda e: e is not null) as nr
      from (select g.*, s.v[greatest(g.x0 - {r.lateral}, 0) + 1:g.x0] as wl, s.v[g.x1 + 2:g.x1 + {r.lateral + 1}] as wr from mgaps g join series s on {same('s', 'g')} where vb is not null and va is not null)""",
)
add_cte(
    "near_shape",
    ("context", "alive"),
    f"""select *, greatest(case when len(d) > 0 then 1.4826 * list_median(list_transform(d, lambda e: abs(e - list_median(d)))) else 0 end, mad_series, 1e-9) as mad from (
      select c.meter_id, c.variable, x0, x1, n, plen, category, vb, va, mad_series, {slopes('nl')} as b_l, {slopes('nr')} as b_r,
      (case when len(nl) >= 2 then {off_chord('nl')} else [] end) || (case when len(nr) >= 2 then {off_chord('nr')} else [] end) as d from context c join alive s on {same('s', 'c')})""",
)
add_cte(
    "flags",
    ("near_shape",),
    f"""select *, abs(b_l) * n > {r.slope_risk} * mad or abs(b_r) * n > {r.slope_risk} * mad as edge_risk, n > {r.long_gap} or regime as low_conf
      from (select *, abs(va - vb) / mad > {r.regime} and n >= {r.regime_length} as regime from near_shape)""",
)
offer = "select l.meter_id, l.variable, {len} as len, x0, n - {len} + 1 as w, sum(n - {len} + 1) over (partition by l.meter_id, l.variable, {len} order by x0)::bigint - (n - {len} + 1) as low, sum(n - {len} + 1) over (partition by l.meter_id, l.variable, {len})::bigint as n_starts from library l {join}"
add_cte("short_offers", ("library",), offer.format(len=long, join=f"where n >= {long}"))
add_cte(
    "textures",
    ("short_offers", "series"),
    f"""select s.meter_id, s.variable, coalesce(s_amp, 0) as s_amp, coalesce(s_freq, 0) as s_freq from series s left join (
      select {CHAN}, quantile_cont(sd, 0.5) as s_amp, quantile_cont(f, 0.5) as s_freq from (select {CHAN}, list_aggregate(d, 'stddev_pop') as sd, {turns('d')} as f from (
      select {CHAN}, {off_chord('v')} as d from (select o.meter_id, o.variable, s.v[o.x0 + pick - low + 1:o.x0 + pick - low + {long}] as v from (
      select *, {mixed_sql('42', 'meter_id', text_code_sql('variable'), 'no')} % n_starts as pick from (select {CHAN}, any_value(n_starts) as n_starts from short_offers group by 1, 2), (select unnest(range({r.texture_draws})) as no)) p
      join short_offers o on {same('o', 'p')} and pick >= low and pick < low + w join series s on {same('s', 'o')}))) group by 1, 2) t on {same('t', 's')}""",
)
add_cte(
    "params",
    ("flags", "capacity", "textures"),
    f"""select *, n > 6 and not supported as bare, case when rich then sd else s_amp end as sig, case when rich then f else s_freq end as fc,
      case when rich then sd * ({gain}) else s_amp end as amp, (va - vb) / (n + 1) as m_gap from (
      select f.* exclude (d), coalesce(cap, 0) as cap, coalesce(cap, 0) >= {r.support_min} and ceil(n / f.plen::double) / greatest(coalesce(cap, 0), 1) <= {r.support_reuse} as supported, s_amp, s_freq,
      list_aggregate(d, 'stddev_pop') as sd, {turns('d')} as f, len(d) >= {r.min_context} and list_aggregate(d, 'stddev_pop') > 1e-9 as rich
      from flags f left join capacity c on {same('c', 'f', 'plen')} join textures t on {same('t', 'f')})""",
)
add_cte("asked", ("params",), f"select * from (select *, least(plen, n - pos) as len from (select *, unnest(range(0, n, greatest(1, plen // 2))) as pos from params where not bare and amp > 1e-9)) where len >= {r.min_fragment}")
add_cte("lengths", ("asked",), f"select distinct {CHAN}, len from asked")
add_cte("offers", ("library", "lengths"), offer.format(len="k.len", join=f"join lengths k on {same('k', 'l')} and l.n >= k.len"))
add_cte(
    "drawn",
    ("asked", "offers"),
    f"""select p.*, o.x0 + pick - low as start from (select a.*, c, {mixed_sql('42', 'a.meter_id', text_code_sql('a.variable'), 'a.x0', 'pos', 'c')} % n_starts as pick from asked a
      join (select {CHAN}, len, any_value(n_starts) as n_starts from offers group by 1, 2, 3) t on {same('t', 'a', 'len')}, (select unnest(range({r.candidates})) as c)) p
      join (select meter_id, variable, len, x0, w, low from offers) o on {same('o', 'p', 'len')} and pick >= low and pick < low + w""",
)
add_cte(
    "fragments",
    ("drawn", "series"),
    f"""select *, list_aggregate(d, 'stddev_pop') as sd, {turns('d')} as f from (select *, {off_chord('v')} as d, {slopes('v')} as slope, v[len(v)] - v[1] as rise from (
      select k.*, s.v[start + 1:start + k.len] as v from (select distinct {CHAN}, start, len from drawn) k join series s on {same('s', 'k')}))""",
)
cost = (
    f"{r.w_freq} * abs(g.f - fc) + {r.w_amp} * abs(g.sd - sig) / (sig + 1e-9) + {r.w_slope} * abs(g.slope - m_gap) * d.len / (sig + 1e-9)"
    f" + {r.w_level} * abs(g.rise - m_gap * d.len) / (sig + 1e-9)"
)
add_cte(
    "picks",
    ("drawn", "fragments"),
    f"""select * from (select d.meter_id, d.variable, x0, x1, n, amp, pos, d.len, d.start, g.d as dev, {R(cost, 6)} as cost, c from drawn d join fragments g on {same('g', 'd', 'start', 'len')})
      qualify row_number() over (partition by {CHAN}, x0, pos order by cost, c) = 1""",
)
add_cte(
    "laid",
    ("picks", "params"),
    f"""with pts as (select {CHAN}, x0, n, amp, pos, len, unnest(range(len)) as i, unnest(dev) as d from picks),
      w as (select *, case when len > 2 then 0.5 - 0.5 * cos(2 * pi() * i / (len - 1)) else 1 end as h from pts),
      s as (select {CHAN}, x0, pos + i as o, sum(h * d) as a, sum(h) as h from w group by 1, 2, 3, 4),
      every_ as (select {CHAN}, x0, x1, n, amp, unnest(range(n)) as o from params where not bare and amp > 1e-9),
      t as (select e.*, coalesce(a / case when h < 1e-9 then 1 else h end, 0) as t from every_ e left join s on {same('s', 'e', 'x0', 'o')}),
      c as (select *, t - (first_value(t) over g + (last_value(t) over g - first_value(t) over g) * o / greatest(n - 1, 1)) as u from t
        window g as (partition by {CHAN}, x0 order by o rows between unbounded preceding and unbounded following))
      select {CHAN}, x0, o, greatest(least(u / sd * amp, {r.envelope} * amp), -{r.envelope} * amp) as tex from (select *, stddev_pop(u) over (partition by {CHAN}, x0) as sd from c) where sd >= 1e-9""",
)
add_cte(
    "levels",
    ("context",),
    f"""with m as (select *, list_median(l) as m_l, list_median(r) as m_r, {slopes('l')} as b_l, {slopes('r')} as b_r from context),
      s as (select *, {spread('l', 'm_l')} as s_l, {spread('r', 'm_r')} as s_r, len(l) >= 3 and len(r) >= 3 as wide from m),
      b as (select *, case when abs(vb - m_l) / s_l <= {r.edge_z} then vb else m_l end as close_b, case when abs(va - m_r) / s_r <= {r.edge_z} then va else m_r end as close_a, {r.drift} * 0.5 * (s_l + s_r) / n as cap,
        exp(-abs(b_l - b_r) / (abs(b_l) + abs(b_r) + 1e-9)) * 0.5 * (b_l + b_r) / (1 + (n / {r.drift_length}) * (n / {r.drift_length})) as raw from s),
      p as (select * exclude (l, r, nl, nr), greatest(least(raw, cap), -cap) as beta, least(0.10, 60.0::double / n) as q, unnest(range(n)) as o from b),
      u as (select *, case when n > 1 then o / (n - 1)::double else 0 end as u from p)
      select {CHAN}, x0, x1, n, x0 + o as x, o, case when wide then m_l + (m_r - m_l) * {smooth('u')} + beta * (o - n / 2.0::double)
        + case when u < q then (1 - {smooth('u / q')}) * (close_b - (m_l + beta * (0 - n / 2.0::double))) else 0 end
        + case when u > 1 - q then {smooth('(u - (1 - q)) / q')} * (close_a - (m_l + (m_r - m_l) * (n > 1)::int + beta * (n - 1 - n / 2.0::double))) else 0 end
        else vb + (va - vb) * (o + 1) / (n + 1.0::double) end as base from u""",
)
# edge gaps: the known values of the neighbouring stretch, one after the other
add_cte(
    "edges",
    ("mgaps", "series"),
    f"""with s as (select g.*, coalesce(va, vb) as anchor, list_filter(case when vb is null then s.v[g.x1 + 2:g.x1 + g.n + 1] else s.v[greatest(g.x0 - g.n, 0) + 1:g.x0] end, lambda e: e is not null) as src
        from mgaps g join series s on {same('s', 'g')} where (vb is null) <> (va is null)),
      k as (select *, len(src) as m, len(src) >= {r.min_fragment} and list_aggregate(src, 'stddev_pop') > 1e-9 as rich from s),
      p as (select *, unnest(range(n)) as o from k)
      select {CHAN}, x0, x1, n, category, x0 + o as x, anchor as base, rich, case when rich and n >= 2 then anchor + src[(o % m) + 1] - (src[1] + (src[((n - 1) % m) + 1] - src[1]) * o / greatest(n - 1, 1)) else anchor end as cand from p""",
)
add_cte(
    "made",
    ("params", "levels", "laid", "edges", "alive"),
    f"""with b as (select l.meter_id, l.variable, l.x0, l.x, l.base, l.base + coalesce(t.tex, 0) as cand, case when p.bare then 'unsupported' when t.tex is not null then 'analog' else 'interp' end as kind,
        case when p.bare then 6 when p.category <= 1 then 1 when p.category >= 4 then 4 when p.low_conf then 3 else 2 end as code, p.edge_risk, p.regime, p.low_conf
        from levels l join params p on {same('p', 'l', 'x0')} left join laid t on {same('t', 'l', 'x0', 'o')}
        union all select {CHAN}, x0, x, base, cand, case when rich then 'analog' else 'edge' end, case when category <= 1 then 1 when category >= 4 then 4 else 2 end, false, false, false from edges),
      c as (select b.* exclude (base), greatest(least(base, hi), lo) as base, lo, hi from b join alive l on {same('l', 'b')}),
      s as (select *, greatest(0, least(1, coalesce(min(case when cand - base > 1e-12 then (hi - base) / (cand - base) when cand - base < -1e-12 then (lo - base) / (cand - base) end) over (partition by {CHAN}, x0), 1))) as scale from c),
      y as (select *, base + scale * (cand - base) as y from s)
      select * exclude (y), greatest(least(y, hi), lo) as y, y < lo - 1e-9 * (hi - lo) or y > hi + 1e-9 * (hi - lo) as clipped from y""",
)
add_cte(
    "refilled",
    ("samples", "micro", "made", "alive"),
    f"""select s.meter_id, s.variable, s.x, s.value as observed, coalesce(s.value, case when l.lo is not null then m.value end, y) as value,
      (case when s.value is not null then 0 when l.lo is not null and m.origin = 'micro' then 1 else coalesce(code, 5) end)::tinyint as code,
      case when s.value is not null then 'observed' when l.lo is not null and m.origin = 'micro' then 'interp' else coalesce(kind, 'unfilled') end as kind,
      coalesce(scale < 0.999999, false) as rescaled, coalesce(clipped, false) as clipped, coalesce(edge_risk, false) as edge_risk, coalesce(regime, false) as regime, coalesce(low_conf, false) as low_conf
      from samples s join micro m on {same('m', 's', 'x')} left join made d on {same('d', 's', 'x')} left join alive l on {same('l', 's')}""",
)
