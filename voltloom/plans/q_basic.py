"""Scans, projections, scalar rules, joins, plain aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.functions import names, scalars
from voltloom.functions.numeric import fixed, share
from voltloom.operators import aggregate, grid, joins, ranks
from voltloom.plans.fixture_sql import R, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources import fixtures, readings
from voltloom.sources.fixtures import VARIABLES

CH = ["meter_id", "variable"]
TIME = "cast(time as timestamp_ntz)"


# ---- scans and sinks -------------------------------------------------------------------------


@query(
    "read_readings",
    """select (user_id % 8 + 1)::int as meter_id, count(*) as n_rows,
       count_if(event_id % 211 = 0) as n_bad_time, min(case when event_id % 211 <> 0 then ts end) as t0
       from events group by 1""",
)
def read_readings(t: Inputs):
    text = F.when(F.col("event_id") % 211 == 0, F.lit("bad stamp")).otherwise(F.col("ts").cast("string"))
    e = t.table("events").select(
        (F.col("user_id") % 8 + 1).cast("int").alias("meter_id"), readings.parse_time(text).alias("time")
    )
    return e.groupBy("meter_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("time").isNull()).alias("n_bad_time"),
        F.min("time").cast("timestamp_ntz").alias("t0"),
    )


@query(
    "drop_exact_duplicates",
    with_tables(
        """select r.meter_id, n_in, n_out, n_in - n_out as n_dup from
        (select meter_id, count(*) as n_in from raw group by 1) r join
        (select meter_id, count(*) as n_out from readings group by 1) d on d.meter_id = r.meter_id""",
        "raw", "readings",
    ),
)
def drop_exact_duplicates(t: Inputs):
    clean = fixtures.cleaned(t.raw)
    different = clean.groupBy(*clean.columns).agg(F.count("*").alias("n"))
    per = different.groupBy("meter_id").agg(F.sum("n").alias("n_in"), F.count("*").alias("n_out"))
    return per.withColumn("n_dup", F.col("n_in") - F.col("n_out"))


@query(
    "split_by_family",
    with_tables(
        """select case when regexp_matches(variable, '^[iv]_[abc]n$') then 'primary'
          when regexp_matches(variable, '^(p|q|s|cos)_[abc]$') then 'secondary'
          when regexp_matches(variable, '^hrm') then 'harmonic' else 'distortion' end as slice,
          count(distinct variable) as n_cols, count(value) as n_cells from samples group by 1""",
        "samples",
    ),
)
def split_by_family(t: Inputs):
    out = None
    for name, part in readings.split_by_family(t.dense, ["meter_id", "x"]).items():
        cols = [c for c in part.columns if c not in ("meter_id", "x")]
        row = part.agg(sum((F.count(c) for c in cols), F.lit(0)).alias("n_cells")).select(
            F.lit(name).alias("slice"), F.lit(len(cols)).cast("long").alias("n_cols"), "n_cells"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("column_pruned_scan", "select l_suppkey, sum(l_quantity) as qty, count(*) as n from lineitem where l_quantity >= 25 group by 1")
def column_pruned_scan(t: Inputs):
    li = t.table("lineitem").select("l_suppkey", "l_quantity").filter("l_quantity >= 25")
    return li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query(
    "read_predictions",
    with_tables(
        "select w.model, count(p.seed) as n_rows from (select model from models union all select 'm99') w"
        " left join predictions p on p.model = w.model group by 1",
        "predictions", "models",
    ),
)
def read_predictions(t: Inputs):
    present = t.predictions.groupBy("model").agg(F.count("*").alias("n_rows"))
    absent = readings.require_models(t.predictions, [*[m for m, _ in fixtures.MODELS], "m99"])
    return present.unionByName(absent.withColumn("n_rows", F.lit(0).cast("long")))


@query(
    "run_metrics",
    with_tables(
        """select count(*) as n_in, (select count(*) from readings) as n_out, count(distinct meter_id) as n_meters,
        min(time) as t0, max(time) as t1, count_if(time is null) as n_null_time from raw""",
        "raw", "readings",
    ),
)
def run_metrics(t: Inputs):
    n_out = t.readings.agg(F.count("*").alias("n_out"))
    return (
        t.raw.agg(
            F.count("*").alias("n_in"), F.count_distinct("meter_id").alias("n_meters"),
            F.min("time").cast("timestamp_ntz").alias("t0"), F.max("time").cast("timestamp_ntz").alias("t1"),
            F.count_if(F.col("time").isNull()).alias("n_null_time"), F.lit(1).alias("one"),
        )
        .join(n_out.withColumn("one", F.lit(1)), "one")
        .drop("one")
    )


_CATALOG = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


@query(
    "table_catalog",
    " union all ".join(
        f"select '{n}' as table_name, (select count(*) from {n}) as n_rows, count(*)::int as n_cols,"
        f" string_agg(column_name, ',' order by column_name) as columns from information_schema.columns"
        f" where table_name = '{n}'"
        for n in _CATALOG
    ),
)
def table_catalog(t: Inputs):
    return readings.table_catalog({n: t.table(n) for n in _CATALOG})


@query(
    "load_dims",
    with_tables(
        "select d.role, count(distinct d.meter_id) as n_meters, count(*) as n_rows from readings r"
        " join meter_dim d on d.meter_id = r.meter_id group by 1",
        "readings", "meter_dim",
    ),
)
def load_dims(t: Inputs):
    rows = t.readings.groupBy("meter_id").agg(F.count("*").alias("n"))
    return rows.join(t.meter_dim, "meter_id").groupBy("role").agg(
        F.count("*").alias("n_meters"), F.sum("n").alias("n_rows")
    )


# ---- projections and scalar rules ---------------------------------------------------------------


@query(
    "variable_dim",
    with_tables(
        """select variable, family, regexp_extract(variable, '_([abc])n?(_[0-9]+)?$', 1) as phase,
          case when family in ('v', 'thdv', 'hrm_v') then 'voltage' else 'energy' end as side,
          family in ('i', 'p', 'q', 's', 'hrm_i') as additive,
          case when family = 'i' then 'i_n' when family = 'hrm_i' then 'hrm_i_3'
            when family in ('v', 'thdv', 'hrm_v') then null else family end as triplet, n
          from (select variable, regexp_extract(variable, '^(hrm_[iv]|thd[iv]|cos|[ivpqs])_', 1) as family,
            count(value) as n from samples group by 1)""",
        "samples",
    ),
)
def variable_dim(t: Inputs):
    return names.describe(t.samples.groupBy("variable").agg(F.count("value").alias("n")))


@query(
    "check_decimal_comma",
    """select 'props' as column_name, avg(case when regexp_matches(props, '^-?[0-9]+,[0-9]+$') then 1 else 0 end)::double as pct from events
       union all select 'value', avg(case when regexp_matches(replace(value::varchar, '.', ','), '^-?[0-9]+,[0-9]+$') then 1 else 0 end)::double from events""",
)
def check_decimal_comma(t: Inputs):
    e = t.table("events").select(
        "props", F.regexp_replace(F.col("value").cast("string"), r"\.", ",").alias("value")
    )
    return aggregate.comma_share(e, ["props", "value"])


@query(
    "null_to_zero",
    with_tables(
        f"""select meter_id, count_if(v_bn is null) as n_null_v, count_if(q_c is null) as n_null_q,
        {R('sum(coalesce(v_bn, 0))', 3)} as sum_v, {R('sum(coalesce(q_c, 0))', 3)} as sum_q from readings group by 1""",
        "readings",
    ),
)
def null_to_zero(t: Inputs):
    r = t.readings.groupBy("meter_id").agg(
        F.count_if(F.col("v_bn").isNull()).alias("n_null_v"), F.count_if(F.col("q_c").isNull()).alias("n_null_q"),
        F.sum(F.coalesce("v_bn", F.lit(0.0))).alias("sv"), F.sum(F.coalesce("q_c", F.lit(0.0))).alias("sq"),
    )
    return r.select("meter_id", "n_null_v", "n_null_q", fixed("sv", 3).alias("sum_v"), fixed("sq", 3).alias("sum_q"))


@query(
    "column_inventory",
    with_tables(
        "select column_name, n_rows, n_null from (select count(*) as n_rows, "
        + ", ".join(f"count_if({v} is null) as {v}" for v in VARIABLES)
        + " from readings) unpivot (n_null for column_name in ("
        + ", ".join(VARIABLES)
        + "))",
        "readings",
    ),
)
def column_inventory(t: Inputs):
    return aggregate.null_inventory(t.readings, VARIABLES)


@query(
    "to_numeric",
    "select try_cast(json_extract_string(props, '$.k') as int) % 10 as bucket, count(*) as n,"
    " count(try_cast(event_type as double)) as n_bad from events group by 1",
)
def to_numeric(t: Inputs):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return (
        t.table("events").groupBy((k % 10).alias("bucket"))
        .agg(F.count("*").alias("n"), F.count(F.col("event_type").try_cast("double")).alias("n_bad"))
    )


@query(
    "normalize_time",
    with_tables(
        "select meter_id, date_trunc('hour', time) as hour, count(*) as n from readings group by 1, 2", "readings"
    ),
)
def normalize_time(t: Inputs):
    x = grid.grid_index(F.col("time"), fixtures.T0, fixtures.STEP)
    r = t.readings.groupBy("meter_id", x.alias("x")).agg(F.count("*").alias("n"))
    return r.select("meter_id", grid.grid_time(F.col("x"), fixtures.T0, fixtures.STEP).cast("timestamp_ntz").alias("hour"), "n")


@query(
    "parse_flag",
    """select event_type, count_if(lower(trim(case when event_id % 4 = 0 then ' TRUE ' when event_id % 4 = 1 then '0'
       when event_id % 4 = 2 then 'Sim' end)) in ('true', '1', '1.0', 'yes', 'sim')) as n_true, count(*) as n from events group by 1""",
)
def parse_flag(t: Inputs):
    r = F.col("event_id") % 4
    text = F.when(r == 0, " TRUE ").when(r == 1, "0").when(r == 2, "Sim")
    return t.table("events").groupBy("event_type").agg(
        F.count_if(names.parse_flag(text)).alias("n_true"), F.count("*").alias("n")
    )


@query(
    "huber",
    with_tables(
        f"""select variable, {R('sum(case when abs(value) <= 2 then 0.5 * value * value else 2 * (abs(value) - 1.0::double) end)', 2)} as loss
        from samples where value is not null group by 1""",
        "samples",
    ),
)
def huber(t: Inputs):
    return t.samples.groupBy("variable").agg(F.sum(scalars.huber("value", 2.0)).alias("s")).select(
        "variable", fixed("s", 2).alias("loss")
    )


@query(
    "rel_change_pct",
    with_tables(
        f"""select meter_id, {R('max(abs(p_b - p_a) / greatest(abs(p_a), 1e-6::double) * 100)', 3)} as max_abs,
        {R('min((p_b - p_a) / greatest(abs(p_a), 1e-6::double) * 100)', 3)} as min_signed from gridded group by 1""",
        "gridded",
    ),
)
def rel_change_pct(t: Inputs):
    g = t.dense.filter("p_a is not null").groupBy("meter_id").agg(
        F.max(scalars.rel_change_pct("p_a", "p_b")).alias("a"),
        F.min(scalars.rel_change_pct("p_a", "p_b", signed=True)).alias("b"),
    )
    return g.select("meter_id", fixed("a", 3).alias("max_abs"), fixed("b", 3).alias("min_signed"))


def _sql_gain() -> str:
    xs, ys = scalars.GAIN_LENGTH, scalars.GAIN
    arms = [f"when n * 30 <= {xs[0]} then {ys[0]}::double"]
    for i in range(3):
        arms.append(
            f"when n * 30 <= {xs[i + 1]} then {ys[i]}::double + ({ys[i + 1]}::double - {ys[i]}::double)"
            f" * (ln(n * 30.0::double) - ln({xs[i]}::double)) / (ln({xs[i + 1]}::double) - ln({xs[i]}::double))"
        )
    return "case " + " ".join(arms) + f" else {ys[3]}::double end"


@query(
    "k_of_length",
    with_tables(f"select meter_id, variable, x0, n, {R(_sql_gain(), 6)} as gain from gaps", "gaps"),
)
def k_of_length(t: Inputs):
    return t.gaps.select(*CH, "x0", "n", fixed(scalars.k_of_length(F.col("n") * 30), 6).alias("gain"))


@query(
    "smoothstep",
    with_tables(
        f"select meter_id, {R('sum(z * z * (3 - 2 * z))', 3)} as total from"
        " (select meter_id, least(greatest((cos_a - 0.75::double) / 0.1::double, 0), 1) as z from gridded) group by 1",
        "gridded",
    ),
)
def smoothstep(t: Inputs):
    z = (F.col("cos_a") - F.lit(0.75)) / F.lit(0.1)
    g = t.dense.filter("cos_a is not null").groupBy("meter_id").agg(F.sum(scalars.smoothstep(z)).alias("s"))
    return g.select("meter_id", fixed("s", 3).alias("total"))


_CAT = "case when n <= 2 then 1 when n <= 6 then 2 when n <= 12 then 3 else 4 end"


@query(
    "confidence_code",
    with_tables(
        f"""select meter_id, code, count(*) as n_gaps, sum(n)::bigint as n_points from (select *, case when cat <= 1 then 1
        when cat >= 4 then 4 when n > 9 then 3 else 2 end as code from (select *, {_CAT} as cat from gaps)) group by 1, 2""",
        "gaps",
    ),
)
def confidence_code(t: Inputs):
    code = scalars.confidence_code(F.expr(_CAT), F.col("n") > 9)
    return t.gaps.withColumn("code", code).groupBy("meter_id", "code").agg(
        F.count("*").alias("n_gaps"), F.sum("n").alias("n_points")
    )


@query(
    "effect_label",
    with_tables(
        """select effect, sig, count(*) as n from (select
        case when d < 0.2 then 'negligible' when d < 0.5 then 'small' when d < 0.8 then 'medium' else 'large' end as effect,
        case when d < 0.001 then '***' when d < 0.01 then '**' when d < 0.05 then '*' else 'ns' end as sig
        from (select abs(cos_a - 0.8::double) * 10 as d from gridded)) group by 1, 2""",
        "gridded",
    ),
)
def effect_label(t: Inputs):
    d = F.abs(F.col("cos_a") - F.lit(0.8)) * 10
    return t.dense.filter("cos_a is not null").groupBy(
        scalars.effect_label(d).alias("effect"), scalars.sig_stars(d).alias("sig")
    ).agg(F.count("*").alias("n"))


@query(
    "assign_role",
    with_tables(
        "select s.meter_id, role, label, count(value) as n from samples s join meter_dim d on d.meter_id = s.meter_id group by 1, 2, 3",
        "samples", "meter_dim",
    ),
)
def assign_role(t: Inputs):
    n = t.samples.groupBy("meter_id").agg(F.count("value").alias("n"))
    return joins.with_dim(n, t.meter_dim.select("meter_id", "role", "label"), ["meter_id"])


@query(
    "scope_filter",
    with_tables(
        """select meter_id, count(*) as n, meter_id in (1, 3, 5, 6) as kept from readings group by 1""", "readings"
    ),
)
def scope_filter(t: Inputs):
    allowed = t.meter_dim.filter("meter_id in (1, 3, 5, 6)").select("meter_id")
    inside, extra = joins.scope(t.readings, allowed, ["meter_id"])
    count = lambda d, kept: d.groupBy("meter_id").agg(F.count("*").alias("n")).withColumn("kept", F.lit(kept))
    return count(inside, True).unionByName(count(extra, False))


# ---- joins --------------------------------------------------------------------------------------


@query(
    "left_equi",
    with_tables(
        "select r.meter_id, coalesce(d.role, 'UNCLASSIFIED') as role, count(*) as n from readings r left join"
        " (select * from meter_dim where meter_id < 6) d on d.meter_id = r.meter_id group by 1, 2",
        "readings", "meter_dim",
    ),
)
def left_equi(t: Inputs):
    dim = t.meter_dim.filter("meter_id < 6").select("meter_id", "role")
    n = t.readings.groupBy("meter_id").agg(F.count("*").alias("n"))
    return joins.with_dim(n, dim, ["meter_id"], {"role": "UNCLASSIFIED"})


_PAIR = """from samples a join samples b on b.variable = a.variable and b.x = a.x
  where a.meter_id = 1 and b.meter_id = 2 and a.value is not null and b.value is not null"""


@query("inner_time", with_tables(f"select a.variable, count(*) as n, {R('corr(a.value, b.value)', 6)} as r {_PAIR} group by 1", "samples"))
def inner_time(t: Inputs):
    both = joins.common_instants(t.samples, 1, 2)
    return both.groupBy("variable").agg(F.count("*").alias("n"), F.corr("value_a", "value_b").alias("c")).select(
        "variable", "n", fixed("c", 6).alias("r")
    )


@query(
    "outer_time",
    with_tables(
        """select coalesce(a.variable, b.variable) as variable, count(*) as n, count(a.x) as n_a, count(b.x) as n_b
        from (select * from samples where meter_id = 3 and value is not null) a
        full join (select * from samples where meter_id = 5 and value is not null) b
        on a.variable = b.variable and a.x = b.x group by 1""",
        "samples",
    ),
)
def outer_time(t: Inputs):
    known = t.samples.filter("value is not null")
    a = known.filter("meter_id = 3").select("variable", "x", F.lit(1).alias("a"))
    b = known.filter("meter_id = 5").select("variable", "x", F.lit(1).alias("b"))
    return a.join(b, ["variable", "x"], "outer").groupBy("variable").agg(
        F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b")
    )


@query(
    "index_intersection",
    with_tables(
        "select count(*) as n, min(x) as x0, max(x) as x1 from (select x from gridded where meter_id = 1"
        " intersect select x from gridded where meter_id = 3)",
        "gridded",
    ),
)
def index_intersection(t: Inputs):
    g = t.dense.filter("p_a is not null")
    both = g.filter("meter_id = 1").select("x").intersect(g.filter("meter_id = 3").select("x"))
    return both.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query(
    "all_pairs",
    with_tables(
        """select a.output, a.model as model_a, b.model as model_b, round(a.n - b.n) as diff from
        (select output, model, count(*) as n from predictions group by 1, 2) a join
        (select output, model, count(*) as n from predictions group by 1, 2) b on a.output = b.output and a.model < b.model""",
        "predictions",
    ),
)
def all_pairs(t: Inputs):
    per = t.predictions.groupBy("output", "model").agg(F.count("*").alias("n"))
    pairs = joins.model_pairs(per, ["output"], "model", "n")
    return pairs.select("output", "model_a", "model_b", (F.col("n_a") - F.col("n_b")).cast("double").alias("diff"))


_BANDS = [(1, 1, 2, 1), (2, 3, 6, 2), (3, 7, 12, 3), (4, 13, None, 4)]


@query(
    "band_lookup",
    with_tables(
        """select meter_id, category, portions, count(*) as n_gaps, sum(n)::bigint as points from gaps join
        (values (1, 1, 2, 1), (2, 3, 6, 2), (3, 7, 12, 3), (4, 13, null, 4)) b(category, lo, hi, portions)
        on n >= lo and (hi is null or n <= hi) group by 1, 2, 3""",
        "gaps",
    ),
)
def band_lookup(t: Inputs):
    hit = joins.band_lookup(t.gaps, "n", _BANDS)
    return hit.groupBy("meter_id", "category", "portions").agg(
        F.count("*").alias("n_gaps"), F.sum("n").alias("points")
    )


@query(
    "semi_anti",
    """select 'semi' as kind, count(*) as n from customer where c_custkey in (select o_custkey from orders)
       union all select 'anti', count(*) from customer where c_custkey not in (select o_custkey from orders)""",
)
def semi_anti(t: Inputs):
    buyers = t.table("orders").select(F.col("o_custkey").alias("c_custkey"))
    inside, outside = joins.scope(t.table("customer").select("c_custkey"), buyers, ["c_custkey"], broadcast=False)
    return inside.agg(F.count("*").alias("n")).select(F.lit("semi").alias("kind"), "n").unionByName(
        outside.agg(F.count("*").alias("n")).select(F.lit("anti").alias("kind"), "n")
    )


@query("time_range", with_tables("select meter_id, count(*) as n, min(x) as x0, max(x) as x1 from gridded where x between 100 and 400 group by 1", "gridded"))
def time_range(t: Inputs):
    return t.dense.filter("p_a is not null and x between 100 and 400").groupBy("meter_id").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )


@query(
    "lag_correlation",
    with_tables(
        f"""select lag, count(*) as n, {R('corr(a.p_a, b.p_a)', 6)} as r from (select x, p_a from gridded where meter_id = 1) a,
        (select unnest(range(-30, 31)) as lag) l, (select x, p_a from gridded where meter_id = 2) b
        where b.x = a.x + lag group by 1""",
        "gridded",
    ),
)
def lag_correlation(t: Inputs):
    g = t.dense.filter("p_a is not null").select("meter_id", "x", "p_a")
    out = joins.lag_correlation(g.filter("meter_id = 1"), g.filter("meter_id = 2"), "p_a", 30)
    return out.select(F.col("lag").cast("long").alias("lag"), "n", fixed("r", 6).alias("r"))


# ---- plain aggregates -----------------------------------------------------------------------------


@query(
    "meter_overview",
    with_tables(
        f"""select meter_id, count(*) as n_rows, min(time) as t0, max(time) as t1,
        {R("date_diff('microsecond', min(time), max(time)) / 86400000000.0::double", 6)} as days, count_if(time is null) as n_null_time
        from readings group by 1""",
        "readings",
    ),
)
def meter_overview(t: Inputs):
    g = t.readings.groupBy("meter_id").agg(
        F.count("*").alias("n_rows"), F.min("time").alias("a"), F.max("time").alias("b"),
        F.count_if(F.col("time").isNull()).alias("n_null_time"),
    )
    days = (F.unix_micros("b") - F.unix_micros("a")) / F.lit(86400000000.0)
    return g.select(
        "meter_id", "n_rows", F.col("a").cast("timestamp_ntz").alias("t0"), F.col("b").cast("timestamp_ntz").alias("t1"),
        fixed(days, 6).alias("days"), "n_null_time",
    )


@query(
    "row_presence",
    with_tables("select meter_id, x, case when p_a is null then 0 else 1 end as present from dense", "dense"),
)
def row_presence(t: Inputs):
    return t.dense.select("meter_id", "x", F.when(F.col("p_a").isNull(), 0).otherwise(1).alias("present"))


@query(
    "grid_origin",
    with_tables(
        """select max(t0) as latest_start, min(t0) as first_start, max(t1) as last_time, count(*) as n_series from
        (select meter_id, min(time) as t0, max(time) as t1 from readings where meter_id <> 4 group by 1)""",
        "readings",
    ),
)
def grid_origin(t: Inputs):
    o = grid.latest_origin(t.readings, "meter_id", skip=[4])
    return o.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("latest_start", "first_start", "last_time")], "n_series")


@query(
    "coverage",
    with_tables(
        f"select meter_id, count(*) as n_grid, count(p_a) as n_data, count_if(p_a is null) as n_gap,"
        f" {R('count_if(p_a is null) * 100.0::double / count(*)')} as gap_pct from dense group by 1",
        "dense",
    ),
)
def coverage(t: Inputs):
    return grid.coverage(t.dense, "meter_id", F.col("p_a").isNotNull()).withColumn("gap_pct", fixed("gap_pct"))


@query(
    "usable_coverage",
    with_tables(
        """select meter_id, x, max(case when value is not null and variable like 'i\\_%' escape '\\' then 1 else 0 end) as current_present,
        max(case when value is not null and variable like 'p\\_%' escape '\\' then 1 else 0 end) as power_present from samples group by 1, 2""",
        "samples",
    ),
)
def usable_coverage(t: Inputs):
    def any_of(cols):
        return F.greatest(*[F.col(c).isNotNull().cast("int") for c in cols])

    return t.dense.select(
        "meter_id", "x",
        any_of(["i_an", "i_bn", "i_cn"]).alias("current_present"), any_of(["p_a", "p_b", "p_c"]).alias("power_present"),
    )


_MODE_SQL = """(select meter_id, variable, value as mode_value, c as mode_count, n_finite, n_unique from (
  select *, row_number() over (partition by meter_id, variable order by c desc, value) as rn,
    sum(c) over (partition by meter_id, variable) as n_finite, count(*) over (partition by meter_id, variable) as n_unique
  from (select meter_id, variable, value, count(*) as c from samples where value is not null group by 1, 2, 3)) where rn = 1)"""


@query(
    "operational_presence",
    with_tables(
        f"""select s.meter_id, s.x, d.role, max(case when s.value is not null and round(s.value, 6) <> m.mode_value then 1 else 0 end) as operating
        from samples s join {_MODE_SQL} m on m.meter_id = s.meter_id and m.variable = s.variable
        join meter_dim d on d.meter_id = s.meter_id where s.variable in ('i_an', 'i_bn', 'i_cn') group by 1, 2, 3""",
        "samples", "meter_dim",
    ),
)
def operational_presence(t: Inputs):
    cur = t.samples.filter("variable in ('i_an', 'i_bn', 'i_cn')")
    mode = ranks.modal_value(cur, CH, "value").select(*CH, "mode_value")
    on = F.coalesce(F.bround("value", 6) != F.col("mode_value"), F.lit(False)).cast("int")
    out = cur.join(mode, CH).groupBy("meter_id", "x").agg(F.max(on).alias("operating"))
    return joins.with_dim(out, t.meter_dim.select("meter_id", "role"), ["meter_id"])


@query(
    "modal_floor",
    with_tables(
        f"""select meter_id, variable, mode_value, mode_count, n_finite::bigint as n_finite,
        n_finite >= 10 and mode_count >= 0.02 * n_finite and mode_count >= 20 as is_floor from {_MODE_SQL}""",
        "samples",
    ),
)
def modal_floor(t: Inputs):
    m = ranks.modal_value(t.samples, CH, "value")
    return m.select(*CH, "mode_value", "mode_count", "n_finite", aggregate.is_floor().alias("is_floor"))


@query(
    "r2_multi",
    f"""select l_suppkey, count(*) as n, {R('regr_r2(l_extendedprice, l_quantity)', 6)} as r2_one from lineitem group by 1""",
)
def r2_multi(t: Inputs):
    li = t.table("lineitem")
    out = aggregate.r2_multi(li, ["l_suppkey"], F.col("l_extendedprice"), [F.col("l_quantity")])
    return out.select("l_suppkey", "n", fixed("r2", 6).alias("r2_one"))



@query(
    "r2_two_regressors",
    f"""with c as (select l_suppkey, count(*) as n, regr_sxx(l_quantity, l_extendedprice) as syy_, covar_pop(l_quantity, l_quantity) as s11,
      covar_pop(l_tax, l_tax) as s22, covar_pop(l_quantity, l_tax) as s12, covar_pop(l_extendedprice, l_quantity) as s1y,
      covar_pop(l_extendedprice, l_tax) as s2y, var_pop(l_extendedprice) as syy from lineitem group by 1)
    select l_suppkey, n, {R('(s1y * (s1y * s22 - s2y * s12) + s2y * (s2y * s11 - s1y * s12)) / (s11 * s22 - s12 * s12) / syy', 6)} as r2 from c""",
)
def r2_two_regressors(t: Inputs):
    li = t.table("lineitem")
    out = aggregate.r2_multi(li, ["l_suppkey"], F.col("l_extendedprice"), [F.col("l_quantity"), F.col("l_tax")])
    return out.select("l_suppkey", "n", fixed("r2", 6).alias("r2"))


@query(
    "signed_corr",
    "select l_suppkey, coalesce(sign(corr(l_extendedprice, l_tax)), 0)::int as sgn from lineitem group by 1",
)
def signed_corr(t: Inputs):
    return aggregate.signed_corr(t.table("lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_tax")).select(
        "l_suppkey", "sgn"
    )


@query(
    "frac_violation",
    with_tables(
        f"select meter_id, {R('count_if(p_a < 0)::double / nullif(count_if(p_a <> 0), 0)', 6)} as reverse_frac from gridded group by 1",
        "gridded",
    ),
)
def frac_violation(t: Inputs):
    valid = F.col("p_a").isNotNull() & (F.col("p_a") != 0)
    return t.dense.groupBy("meter_id").agg(share(F.col("p_a") < 0, valid).alias("f")).select(
        "meter_id", fixed("f", 6).alias("reverse_frac")
    )


@query(
    "energy_uniform",
    with_tables(
        f"select meter_id, variable, {R('coalesce(sum(value), 0) * 60 / 60000.0::double')} as kwh from samples"
        " where variable in ('p_a', 'p_b', 'p_c') group by 1, 2",
        "samples",
    ),
)
def energy_uniform(t: Inputs):
    p = t.samples.filter("variable in ('p_a', 'p_b', 'p_c')")
    return aggregate.energy_uniform(p, CH, F.col("value"), step_hours=1.0).select(*CH, fixed("kwh").alias("kwh"))


@query(
    "energy_trapezoid",
    with_tables(
        f"""select meter_id, variable, {R('coalesce(sum(w), 0) / 3600000.0::double', 6)} as kwh from (
        select meter_id, variable, 0.5::double * (value + lead(value) over w) * least(greatest(
          (epoch_us(lead(time) over w) - epoch_us(time)) / 1000000.0::double, 0), 300) as w
        from (select meter_id, time, unnest(['p_a', 'p_b', 'p_c']) as variable, unnest([p_a, p_b, p_c]) as value from readings)
        where value is not null window w as (partition by meter_id, variable order by time)) group by 1, 2""",
        "readings",
    ),
)
def energy_trapezoid(t: Inputs):
    long = grid.to_long(t.readings, ["meter_id", "time"], ["p_a", "p_b", "p_c"]).filter("value is not null")
    out = aggregate.energy_trapezoid(long, CH, "time", "value", slot_hours=168)
    return out.select(*CH, fixed("kwh", 6).alias("kwh"))


@query(
    "class_counts",
    f"""select event_type as class_name, count(*) as n, {R('count(*) * 100.0::double / (select count(*) from events)')} as pct,
        count_if(value > 100) as n_flag from events group by 1""",
)
def class_counts(t: Inputs):
    out = aggregate.class_counts(t.table("events"), "event_type", {"n_flag": F.col("value") > 100})
    return out.select(F.col("event_type").alias("class_name"), "n", fixed("pct").alias("pct"), "n_flag")


@query(
    "pseudo_meter",
    with_tables(
        f"""select 100 as meter_id, x, variable, {R("case when regexp_matches(variable, '^(i|p|q|s|hrm_i)_') then sum(value) else avg(value) end")} as value
        from samples s where meter_id in (4, 5) and exists (select 1 from dense d where d.meter_id = s.meter_id and d.x = s.x and d.i_an > 0.5)
        group by 2, 3""",
        "samples", "dense",
    ),
)
def pseudo_meter(t: Inputs):
    wide = aggregate.pseudo_meter(t.dense, [4, 5], VARIABLES, 100, F.col("i_an") > 0.5)
    long = grid.to_long(wide, ["meter_id", "x"], VARIABLES)
    return long.select("meter_id", "x", "variable", fixed("value").alias("value"))


@query(
    "component_count",
    with_tables(
        f"""select c, count(*) as n_steps, {R('sum(p)', 3)} as power from (select x, count(distinct meter_id) as c, sum(p_a + p_b + p_c) as p
        from gridded where i_an > 0.5 and meter_id not in (select meter_id from meter_dim where role = 'm_g_input') group by 1) group by 1""",
        "gridded", "meter_dim",
    ),
)
def component_count(t: Inputs):
    main = t.meter_dim.filter("role = 'm_g_input'").select("meter_id")
    out = aggregate.component_count(t.dense.join(F.broadcast(main), "meter_id", "left_anti"), F.col("i_an") > 0.5, F.col("p_a") + F.col("p_b") + F.col("p_c"))
    return out.select("c", "n_steps", fixed("power", 3).alias("power"))


@query(
    "subtotals",
    """select coalesce(o_orderpriority, 'ALL') as priority, coalesce(c_mktsegment, 'ALL') as segment, count(*) as n
       from orders join customer on c_custkey = o_custkey group by grouping sets ((o_orderpriority, c_mktsegment), (o_orderpriority), ())""",
)
def subtotals(t: Inputs):
    j = t.table("orders").join(t.table("customer"), F.expr("c_custkey = o_custkey"))
    return aggregate.subtotals(
        j, {"priority": "o_orderpriority", "segment": "c_mktsegment"}, {"n": F.count("*")}
    )


@query(
    "pivot",
    """select o_orderpriority, count_if(c_mktsegment = 'BUILDING') as "BUILDING", count_if(c_mktsegment = 'HOUSEHOLD') as "HOUSEHOLD",
       count_if(c_mktsegment = 'MACHINERY') as "MACHINERY" from orders join customer on c_custkey = o_custkey group by 1""",
)
def pivot(t: Inputs):
    j = t.table("orders").join(t.table("customer"), F.expr("c_custkey = o_custkey"))
    return (
        j.groupBy("o_orderpriority").pivot("c_mktsegment", ["BUILDING", "HOUSEHOLD", "MACHINERY"])
        .agg(F.count("o_orderkey")).na.fill(0)
    )


@query(
    "log_histogram",
    with_tables(
        """with e as (select [floor(pow(10, 3.0::double * i / 40) + 1e-9)::bigint for i in range(41)] as all_edges),
        u as (select list_sort(list_distinct(all_edges)) as edges from e),
        b as (select unnest(range(1, len(edges)))::int as bin, edges from u),
        bins as (select bin, edges[bin] as lo, edges[bin + 1] as hi, bin = len(edges) - 1 as is_last from b)
        select bin, lo, hi, count(g.n) as n_gaps from bins left join gaps g on g.n >= lo and (g.n < hi or (is_last and g.n = hi)) group by 1, 2, 3""",
        "gaps",
    ),
)
def log_histogram(t: Inputs):
    return aggregate.log_histogram(t.gaps, "n", 3.0, 40)


# ---- sorts, top-k, set operations --------------------------------------------------------------------


@query("stable_sort", with_tables("select meter_id, time, p_a from (select meter_id, time, any_value(p_a) as p_a, count(*) from readings group by 1, 2) order by meter_id, time", "readings"))
def stable_sort(t: Inputs):
    return t.readings.groupBy("meter_id", "time").agg(F.first("p_a").alias("p_a")).orderBy("meter_id", "time").select(
        "meter_id", F.col("time").cast("timestamp_ntz").alias("time"), "p_a"
    )


@query(
    "top_k",
    "select event_type, k, n, rn from (select *, row_number() over (partition by event_type order by n desc, k) as rn from"
    " (select event_type, json_extract_string(props, '$.k')::int as k, count(*) as n from events group by 1, 2)) where rn <= 5",
)
def top_k(t: Inputs):
    c = t.table("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(
        F.count("*").alias("n")
    )
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "k")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")


@query(
    "best_of_group",
    "select o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': -o_orderkey}) as best from orders group by 1",
)
def best_of_group(t: Inputs):
    return t.table("orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best")
    )


@query(
    "union_all",
    "select 'order' as kind, o_custkey as id, null::int as nation from orders union all select 'customer', c_custkey, c_nationkey from customer",
)
def union_all(t: Inputs):
    a = t.table("orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("id"))
    b = t.table("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("intersect_keys", "select c_custkey as id from customer intersect select o_custkey from orders")
def intersect_keys(t: Inputs):
    return t.table("customer").select(F.col("c_custkey").alias("id")).intersect(
        t.table("orders").select(F.col("o_custkey").alias("id"))
    )


@query("difference_keys", "select c_custkey as id from customer except select o_custkey from orders")
def difference_keys(t: Inputs):
    return t.table("customer").select(F.col("c_custkey").alias("id")).join(
        t.table("orders").select(F.col("o_custkey").alias("id")), "id", "left_anti"
    )


@query(
    "one_row_per_key",
    "select o_orderpriority, min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by 1",
)
def one_row_per_key(t: Inputs):
    return t.table("orders").groupBy("o_orderpriority").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice")
    )


@query("distinct_union", "select distinct l_suppkey from lineitem where l_returnflag in ('A', 'R')")
def distinct_union(t: Inputs):
    li = t.table("lineitem")
    a = li.filter("l_returnflag = 'A'").select("l_suppkey")
    return a.unionByName(li.filter("l_returnflag = 'R'").select("l_suppkey")).distinct()
