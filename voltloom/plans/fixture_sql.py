"""The derived tables as SQL, for the queries' SQL twins."""

from __future__ import annotations

from voltloom.functions.numeric import fixed_sql
from voltloom.sources.fixtures import EPOCHS, FLOOR, METERS, MODEL_ROWS, VARIABLES

R = fixed_sql


def _raw() -> str:
    amp = {"a": "10.0", "b": "12.0", "c": "15.0"}
    volt = {"a": "210", "b": "212", "c": "214"}
    floor = "((meter_id = 4 and day(ts) between 10 and 14) or meter_id = 8)"
    out = []
    for p in "abc":
        v = f"({volt[p]}::double + k / 10.0::double)"
        i = f"(value / {amp[p]}::double)"
        s = f"({v} * {i})"
        act = f"({s} * cosv)"
        act = f"(case when event_type = 'error' and meter_id = 2 then -{act} else {act} end)"
        if p == "a":
            act = f"(case when event_id % 397 = 0 then {act} * 50.0::double else {act} end)"
        rea = f"({s} * sqrt(1.0::double - cosv * cosv))"
        rea = f"(case when meter_id = 3 then {rea} * 1.5::double else {rea} end)"
        rea = f"(case when {floor} then {FLOOR}::double else {rea} end)"
        if p == "c":
            rea = f"(case when event_id % 59 = 0 then 'nan'::double else {rea} end)"
        vv = f"(case when event_id % 53 = 0 then null else {v} end)" if p == "b" else v
        out += [
            f"{vv} as v_{p}n",
            f"case when {floor} then {FLOOR}::double else {i} end as i_{p}n",
            f"case when {floor} then {FLOOR}::double else {s} end as s_{p}",
            f"cosv as cos_{p}",
            f"case when {floor} then {FLOOR}::double else {act} end as p_{p}",
            f"{rea} as q_{p}",
            f"k / 10.0::double as thdi_{p}",
            f"k / 20.0::double as thdv_{p}",
            f"k * 1.02::double as hrm_i_{p}n_3",
            f"k / 25.0::double as hrm_v_{p}n_5",
        ]
    return f"""select meter_id, ts as time, k, {', '.join(VARIABLES)} from (
      select *, {', '.join(out)} from (
        select event_id, ts, event_type, value, unnest(case when user_id % 8 + 1 = 6 then [6, 7] else [(user_id % 8 + 1)::int] end) as meter_id,
          unnest_copy, (props->>'$.k')::int as k, 0.70::double + (event_id % 25) / 100.0::double as cosv
        from (select *, unnest(case when event_id % 101 = 0 then [0, 1] else [0] end) as unnest_copy from events)
        where user_id % 8 + 1 <> 7)
      where not (meter_id = 5 and day(ts) between 20 and 22))"""


def _unpivot(source: str) -> str:
    names = ", ".join(f"'{v}'" for v in VARIABLES)
    values = ", ".join(VARIABLES)
    return f"select meter_id, x, unnest([{names}]) as variable, unnest([{values}]) as value from {source}"


_meter_rows = ", ".join(
    f"({m}, '{label}', '{role}', {g if g else 'null'})" for m, label, role, g in METERS
)

_model_rows = ", ".join(f"('{m}', {w}, '{family}', {shift}::double, {lean}::double)" for m, w, family, shift, lean in MODEL_ROWS)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), _raw()),
    "readings": (
        ("raw",),
        "select distinct meter_id, time, k, "
        + ", ".join(f"case when isnan({v}) then null else {v} end as {v}" for v in VARIABLES)
        + " from raw",
    ),
    "gridded": (
        ("readings",),
        "select meter_id, floor(epoch(time - timestamp '2024-01-01') / 3600)::bigint as x, "
        + ", ".join(f"{R(f'avg(coalesce({v}, 0.0::double))')} as {v}" for v in VARIABLES)
        + " from readings group by 1, 2",
    ),
    "dense": (
        ("gridded",),
        "select c.meter_id, c.x, "
        + ", ".join(f"g.{v}" for v in VARIABLES)
        + " from (select meter_id, unnest(range(lo, hi)) as x from (select distinct meter_id from gridded),"
        " (select least(0, min(x)) as lo, max(x) + 1 as hi from gridded)) c"
        " left join gridded g on g.meter_id = c.meter_id and g.x = c.x",
    ),
    "span": (
        ("dense",),
        "select steps, steps * 8 // 10 as train_end, steps * 9 // 10 as valid_end, steps // 6 as fold, steps - 5 * (steps // 6) as first"
        " from (select max(x) + 1 as steps from dense)",
    ),
    "samples": (("dense",), _unpivot("dense")),
    "meter_dim": (
        (),
        f"select * from (values {_meter_rows}) t(meter_id, label, role, gamma_id)",
    ),
    "models": (
        (),
        f"select * from (values {_model_rows}) t(model, w, family, shift, lean)",
    ),
    "truth": (
        ("samples", "meter_dim"),
        "select 'G' || d.gamma_id || '_' || upper(substr(variable, 3, 1)) as output, d.gamma_id as gamma,"
        " upper(substr(variable, 3, 1)) as phase, s.meter_id, variable, x, coalesce(value, 0.0::double) as y"
        " from samples s join meter_dim d on d.meter_id = s.meter_id"
        " where d.role = 'modeled_loads' and variable in ('p_a', 'p_b', 'p_c')",
    ),
    "predictions": (
        ("truth", "span", "models"),
        "select model, seed, x - w // 2 as window_idx, output,"
        " y * (1.0::double + (((x * seed + gamma) % 7) - 3) / 100.0::double"
        " + shift + lean * ((gamma * w // 6 + ascii(phase)) % 5 - 2)) as y_pred"
        " from truth, models, (select unnest([1, 2, 3, 4, 5]) as seed)"
        " where x - w // 2 between 0 and (select steps from span) - w",
    ),
    "gaps": (
        ("samples",),
        "select meter_id, variable, min(x) as x0, max(x) as x1, count(*) as n from ("
        " select meter_id, variable, x, x - row_number() over (partition by meter_id, variable order by x) as g"
        " from samples where value is null) group by meter_id, variable, g",
    ),
    "conf": (
        ("samples", "gaps"),
        "select s.meter_id, s.variable, s.x, case when g.n is null then 0 when g.n <= 2 then 1"
        " when g.n <= 24 then 2 else 3 end as code from samples s left join gaps g"
        " on g.meter_id = s.meter_id and g.variable = s.variable and s.x between g.x0 and g.x1",
    ),
}

CTES.update({
    "scored": (
        ("predictions", "truth", "models"),
        "select p.model, p.seed, p.output, t.gamma, t.phase, t.x, t.y, p.y_pred from predictions p join models m on m.model = p.model"
        " join truth t on t.output = p.output and t.x = p.window_idx + m.w // 2",
    ),
    "history": (
        ("scored", "span"),
        "select model, seed, epoch, train * (1 + 4.0::double / epoch) ** 2 as loss, valid * (1 + 4.0::double / epoch) ** 2 as val_loss from (select model, seed,"
        " avg((y_pred - y) * (y_pred - y)) filter (x < (select train_end from span)) as train,"
        " avg((y_pred - y) * (y_pred - y)) filter (x >= (select train_end from span) and x < (select valid_end from span)) as valid"
        f" from scored group by 1, 2), (select unnest(range(1, {EPOCHS + 1})) as epoch)",
    ),
    "load_metrics": (
        ("scored",),
        "select *, e_true - e_pred as delta, abs(e_true - e_pred) / (sum(abs(e_true)) over (partition by model, seed) + 1e-9::double) * 100"
        " as contrib_pct, abs(e_true) >= 1 as active from (select model, seed, output, gamma, phase,"
        " sum(abs(y_pred - y)) / (sum(abs(y)) + 1e-9::double) * 100 as nae_pct, avg(abs(y_pred - y)) as mae_w,"
        " sum(y) / 1000.0::double as e_true, sum(y_pred) / 1000.0::double as e_pred from scored group by 1, 2, 3, 4, 5)",
    ),
    "system": (
        ("load_metrics",),
        "select *, abs(e_pred - e_true) / (abs(e_true) + 1e-9::double) * 100 as erg_pct from (select model, seed,"
        " coalesce(avg(nae_pct) filter (active), avg(nae_pct)) as nae_mean, sum(e_true) as e_true, sum(e_pred) as e_pred"
        " from load_metrics group by 1, 2)",
    ),
    "parts": (
        ("dense",),
        "select meter_id, unnest(['A', 'B', 'C']) as phase, x, coalesce(unnest([p_a, p_b, p_c]), 0) as p from dense",
    ),
    "balance": (
        ("scored", "parts"),
        "select s.*, r.po, m.mg_real from (select model, phase, x, sum(y) as obs, sum(p) as pred from"
        " (select model, phase, x, output, any_value(y) as y, avg(y_pred) as p from scored group by 1, 2, 3, 4) group by 1, 2, 3) s"
        " join (select phase, x, sum(p) as po from parts where meter_id in (2, 4) group by 1, 2) r on r.phase = s.phase and r.x = s.x"
        " join (select phase, x, sum(p) as mg_real from parts where meter_id = 1 group by 1, 2) m on m.phase = s.phase and m.x = s.x",
    ),
    "energies": (
        ("balance",),
        "select *, lo - mg as r1_obs, lp - mg as r1_pred, lo + ot - mg as r2_obs, lp + ot - mg as r2_pred from (select model, phase,"
        " sum(obs + po) / 1000.0::double as mg, sum(po) / 1000.0::double as ot, sum(obs) / 1000.0::double as lo,"
        " sum(pred) / 1000.0::double as lp, sum(mg_real) / 1000.0::double as mgr from balance group by 1, 2)",
    ),
    "budget": (
        ("scored",),
        """select *, sqrt(u_met * u_met + u_seed * u_seed + u_sync * u_sync) as u_total from (
        select model, phase, 0.005::double * avg(e_obs) as u_met, stddev_samp(e0) as u_seed, avg(sqrt((dm * dm + dp * dp) / 2)) as u_sync, avg(e0) as e_res
        from (select model, seed, phase, e_obs, e0, dp, dm from (
          select model, seed, phase, abs(sum(o) / 1000.0::double) as e_obs, sum(p - o) / 1000.0::double as e0, sum(o - oa) / 1000.0::double as dp,
            sum(o - ob) / 1000.0::double as dm from (
            select s.model, s.seed, s.phase, s.x, s.p, h.o, h.oa, h.ob from
              (select model, seed, phase, x, sum(y_pred) as p, min(x) over (partition by model) as lo, max(x) over (partition by model) as hi
               from scored group by 1, 2, 3, 4) s
            join (select phase, x, o, 0.5 * (o + lead(o) over w) as oa, 0.5 * (lag(o) over w + o) as ob from
              (select phase, x, sum(y) as o from truth group by 1, 2) window w as (partition by phase order by x)) h
            on h.phase = s.phase and h.x = s.x where s.x > lo and s.x < hi) group by 1, 2, 3) p1
          union all select model, seed, 'ABC', sum(e_obs), sum(e0), sum(dp), sum(dm) from (
          select model, seed, phase, abs(sum(o) / 1000.0::double) as e_obs, sum(p - o) / 1000.0::double as e0, sum(o - oa) / 1000.0::double as dp,
            sum(o - ob) / 1000.0::double as dm from (
            select s.model, s.seed, s.phase, s.x, s.p, h.o, h.oa, h.ob from
              (select model, seed, phase, x, sum(y_pred) as p, min(x) over (partition by model) as lo, max(x) over (partition by model) as hi
               from scored group by 1, 2, 3, 4) s
            join (select phase, x, o, 0.5 * (o + lead(o) over w) as oa, 0.5 * (lag(o) over w + o) as ob from
              (select phase, x, sum(y) as o from truth group by 1, 2) window w as (partition by phase order by x)) h
            on h.phase = s.phase and h.x = s.x where s.x > lo and s.x < hi) group by 1, 2, 3) group by 1, 2) group by 1, 2)""",
    ),
})


def add_cte(name: str, needs: tuple[str, ...], body: str) -> None:
    if name in CTES:
        raise ValueError(f"table {name} defined twice")
    CTES[name] = (needs, body)


def with_tables(body: str, *names: str) -> str:
    """Prefix a query with the derived tables it names, in order of need.

    ``body`` may itself start with ``with``: its tables are appended.
    """
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in seen)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
