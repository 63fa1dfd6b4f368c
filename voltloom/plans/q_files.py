"""Tables that are written, read back by their parsers and readers, and used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed
from voltloom.operators import gaps, joins, seq
from voltloom.plans import q_audit, q_clean, q_data
from voltloom.plans.fixture_sql import R, with_tables
from voltloom.plans.registry import Inputs, query
from voltloom.session import shared_dir
from voltloom.sources import decisions, readings
from voltloom.sources.fixtures import BLOCK, VARIABLES


def place(t: Inputs, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def as_csv(t: Inputs, name: str, df: DataFrame) -> DataFrame:
    """The table after a round through text."""
    path = place(t, name)
    df.write.option("header", True).csv(path)
    return decisions.read_table(t.spark, path)


@query(
    "approved_meters",
    with_tables(
        """with r as (select *, n_rows::double / max(n_rows) over () as cov from quality) select meter_id, case when meter_id = 2 then false when meter_id = 1 then true else not (pct_sentinel >= 60 or pct_useful < 40 or cov < 0.5) end as process from r""",
        "quality",
    ),
)
def approved_meters(t: Inputs):
    """The scope decision, written as text and parsed again."""
    own = q_clean.scope_decision(t).select("meter_id", "verdict", F.when(F.col("process"), F.when(F.col("meter_id") % 2 == 0, "Yes").otherwise("TRUE")).otherwise("no").alias("process_in_next_script"))
    return decisions.scope_decision(as_csv(t, "scope", own))


@query("dead_power_channels", with_tables("select distinct meter_id, right(variable, 1) as phase from live where dead and variable in ('p_a', 'p_b', 'p_c')", "live"))
def dead_power_channels(t: Inputs):
    """Dead power channels, named by variable or by label."""
    dead = q_audit.live(t).filter("dead and variable in ('p_a', 'p_b', 'p_c')")
    label = F.concat(F.lit("M0"), "meter_id", F.lit("-"), F.upper(F.right("variable", F.lit(1))))
    own = dead.select("meter_id", F.when(F.col("variable") == "p_b", F.col("variable")).alias("variavel"), F.when(F.col("variable") != "p_b", label).alias("channel"))
    return decisions.dead_power_channels(as_csv(t, "dead", own))


@query("dead_pairs", with_tables("select distinct meter_id, variable from live where dead", "live"))
def dead_pairs(t: Inputs):
    return decisions.dead_pairs(as_csv(t, "pairs", q_audit.live(t).filter("dead").select("meter_id", F.col("variable").alias("variavel"))))


@query(
    "ruled_portions",
    with_tables(
        """select g.meter_id, g.variable, g.x0, g.n, r.category::int as category, r.portions::int as portions from gaps g join rule07 r on g.n * 60 >= r.min_min and (r.max_min is null or g.n * 60 <= r.max_min)""",
        "gaps", "rule07",
    ),
)
def ruled_portions(t: Inputs):
    """Category and portions of each gap by the rule found in the data, after the rule went through text."""
    rule = gaps.gap_rule(q_data.longest(t)).withColumnRenamed("portions", "n_porcoes_onda")
    bands = decisions.gap_rule(as_csv(t, "rule", rule))
    return joins.band_lookup(t.gaps.withColumn("minutes", F.col("n") * 60), "minutes", bands).select("meter_id", "variable", "x0", "n", "category", "portions")


@query("standardized_days", with_tables(f"select time::date as date, count(*) as n_rows, count(distinct meter_id) as n_meters, {R('sum(p_a)', 2)} as p_a from readings group by 1", "readings"))
def standardized_days(t: Inputs):
    """The standardised copy, a folder a day, read back."""
    path = place(t, "standard")
    readings.write_standardized(t.readings, path)
    back = readings.read_any(t.spark, path)
    return back.groupBy("date").agg(F.count("*").alias("n_rows"), F.count_distinct("meter_id").alias("n_meters"), fixed(F.sum("p_a"), 2).alias("p_a"))


@query("csv_readings", with_tables(f"select meter_id, count(*) as n_rows, count(time) as n_times, {', '.join(f'count({v}) as {v}' for v in VARIABLES)} from readings group by 1", "readings"))
def csv_readings(t: Inputs):
    """Readings through a CSV with a given schema: known cells of each column."""
    path = place(t, "readings")
    t.readings.select("time", "meter_id", *VARIABLES).write.option("header", True).csv(path + ".csv")
    back = readings.read_readings(t.spark, path + ".csv", VARIABLES)
    return back.groupBy("meter_id").agg(F.count("*").alias("n_rows"), F.count("time").alias("n_times"), *[F.count(v).alias(v) for v in VARIABLES])


@query(
    "windows_by_split",
    with_tables(
        """with s as (select meter_id, x, case when x < (select train_end from span) then 'train' when x < (select valid_end from span) then 'val' else 'test' end as split, coalesce(p_a, 0) as v from dense)
        select meter_id, split, count(*) as n_windows, floor(sum(total) * 1000 + 0.50031) / 1000 as total from (select *, count(*) over w as n, sum(v) over w as total from s window w as (partition by meter_id, split order by x rows between current row and 11 following)) where n = 12 group by 1, 2""",
        "dense", "span",
    ),
)
def windows_by_split(t: Inputs):
    """Windows of every meter, written in a folder for each split and read back."""
    path = place(t, "windows")
    rows = t.dense.select("meter_id", "x", F.coalesce("p_a", F.lit(0.0)).alias("p")).withColumn("split", t.split())
    readings.write_windows(seq.windows(rows, ["meter_id", "split"], ["p"], 12, block=BLOCK), path)
    back = t.spark.read.parquet(path)
    total = F.aggregate(F.col("window.p"), F.lit(0.0), lambda a, b: a + b)
    return back.groupBy("meter_id", "split").agg(F.count("*").alias("n_windows"), fixed(F.sum(total), 3).alias("total"))


@query(
    "feature_set_files",
    with_tables(
        """with i as (select variable as feature, sum(abs(value)) as w from samples group by 1), r as (select feature, row_number() over (order by w desc, feature) as rank from i)
        select 'all' as set, rank, feature from r union all select 'top12', rank, feature from r where rank <= 12""",
        "samples",
    ),
)
def feature_set_files(t: Inputs):
    """Feature sets written and read back by name."""
    w = t.samples.groupBy(F.col("variable").alias("feature")).agg(F.sum(F.abs("value")).alias("w"))
    ranked = w.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("w"), "feature")))  # a row a feature
    sets = ranked.withColumn("set", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("rank") <= 12, F.lit("top12"))))))
    path = place(t, "sets")
    readings.write_feature_sets(sets, path)
    return readings.read_feature_set(t.spark, path, "all").unionByName(readings.read_feature_set(t.spark, path, "top12")).select("set", "rank", "feature")
