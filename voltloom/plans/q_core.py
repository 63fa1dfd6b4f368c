"""Fixture checks and the minimum slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.operators import ranks, seq
from voltloom.plans.fixture_sql import R, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.sources.fixtures import BLOCK

CH = ["meter_id", "variable"]


@query("grid_mean", with_tables("select meter_id, variable, x, value from samples where value is not null", "samples"))
def grid_mean(t: Inputs):
    return t.samples.filter("value is not null")


@query(
    "dense_grid",
    with_tables(
        "select meter_id, variable, count(*) as n_grid, count(value) as n_data, min(x) as x0, max(x) as x1"
        " from samples group by 1, 2",
        "samples",
    ),
)
def dense_grid(t: Inputs):
    return t.samples.groupBy(*CH).agg(
        F.count("*").alias("n_grid"), F.count("value").alias("n_data"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
    )


@query("runs", with_tables("select * from gaps where n >= 2", "gaps"))
def runs(t: Inputs):
    return seq.runs(t.samples, CH, F.col("value").isNull(), min_run=2, block=BLOCK)


@query(
    "close_short_gaps",
    with_tables(
        """with b as (select *, case when x0 - lag(x1) over w - 1 <= 10 then 0 else 1 end as s from gaps
             window w as (partition by meter_id, variable order by x0)),
           c as (select *, sum(s) over (partition by meter_id, variable order by x0) as g from b)
           select meter_id, variable, min(x0) as x0, max(x1) as x1, max(x1) - min(x0) + 1 as n from c
           group by meter_id, variable, g""",
        "gaps",
    ),
)
def close_short_gaps(t: Inputs):
    return seq.close_gaps(t.samples, CH, F.col("value").isNull(), 10, block=BLOCK)


@query(
    "robust_stats",
    with_tables(
        f"""with m as (select meter_id, variable, quantile_cont(value, 0.5) as med from samples group by 1, 2)
        select s.meter_id, s.variable, count(*) as n, {R('any_value(m.med)')} as median,
          {R('quantile_cont(value, 0.25)')} as q25, {R('quantile_cont(value, 0.75)')} as q75,
          {R('quantile_cont(value, 0.05)')} as q05, {R('quantile_cont(value, 0.95)')} as q95,
          {R('1.4826::double * quantile_cont(abs(value - m.med), 0.5)')} as mad,
          {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} as iqr,
          {R('1.4826::double * quantile_cont(abs(value - m.med), 0.5) / nullif(abs(any_value(m.med)), 0)')} as robust_cv,
          count(distinct value) as n_unique
        from samples s join m on m.meter_id = s.meter_id and m.variable = s.variable
        where value is not null group by 1, 2""",
        "samples",
    ),
)
def robust_stats(t: Inputs):
    st = ranks.median_mad(t.samples, CH, "value", {"q25": 0.25, "q75": 0.75, "q05": 0.05, "q95": 0.95})
    uniq = ranks.modal_value(t.samples, CH, "value").select(*CH, "n_unique")
    return st.join(uniq, CH).select(
        *CH, "n", "n_unique",
        *[fixed(c).alias(c) for c in ("median", "q25", "q75", "q05", "q95", "mad")],
        fixed(F.col("q75") - F.col("q25")).alias("iqr"),
        fixed(F.col("mad") / F.nullif(F.abs("median"), F.lit(0.0))).alias("robust_cv"),
    )
