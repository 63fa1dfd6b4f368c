"""Files in and out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voltloom.plans.registry import inputs
from voltloom.sources import decisions, readings


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "r.csv"
    src.write_text("time,meter_id,p_a,v_an\n2024-01-01 00:00:00,1,1.5,220\nnot a time,1,NaN,221\n2024-01-01 00:01:00,2,,222\n")
    df = readings.read_readings(spark, str(src), ["p_a", "v_an"])
    assert df.filter("time is null").count() == 1
    assert df.filter("p_a is null").count() == 2
    out = str(tmp_path / "std")
    readings.write_standardized(df, out)
    assert readings.read_any(spark, out).count() == 3
    assert readings.read_any(spark, str(src)).columns == ["time", "meter_id", "p_a", "v_an"]
    typed = readings.read_any(spark, str(src), "time string, meter_id int, p_a double, v_an double")
    assert dict(typed.dtypes)["p_a"] == "double" and typed.filter("meter_id = 1").count() == 2
    parts = readings.split_by_family(df, ["time", "meter_id"])
    assert parts["primary"].columns == ["time", "meter_id", "v_an"] and parts["secondary"].columns[-1] == "p_a"


def test_predictions_and_sets(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.range(3).write.parquet(p)
    df = readings.read_predictions(spark, {"m1": p})
    readings.raise_if_any(readings.require_models(df, ["m1"]), "missing")
    with pytest.raises(ValueError):
        readings.raise_if_any(readings.require_models(df, ["m1", "m2"]), "missing")
    s = spark.createDataFrame([("knee", 2, "b"), ("knee", 1, "a"), ("all", 1, "c")], "set string, rank int, feature string")
    readings.write_feature_sets(s, str(tmp_path / "s"))
    assert [r.feature for r in readings.read_feature_set(spark, str(tmp_path / "s"), "knee").collect()] == ["a", "b"]
    w = spark.createDataFrame([("train", [[1.0]])], "split string, window array<array<double>>")
    readings.write_windows(w, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).select(F.col("split")).first()[0] == "train"


def test_calendar_follows_the_data(spark, tmp_path):
    """A reading on day 45 is on the grid, and so are the hours before it."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = events.limit(1).selectExpr("event_id", "timestamp_ntz'2024-02-14 05:10:00' as ts", "user_id", "event_type", "value", "props") if dict(events.dtypes)["ts"] == "timestamp_ntz" else events.limit(1).withColumn("ts", F.lit("2024-02-14 05:10:00").cast("timestamp"))
    events.unionByName(late.select(events.columns)).write.parquet(str(tmp_path / "events.parquet"))
    t = inputs(spark, str(tmp_path))
    last = 44 * 24 + 5
    assert t.steps == last + 1 and t.train_end == (last + 1) * 8 // 10
    assert t.dense.filter(F.col("x") == last).filter("v_an is not null").count() >= 1
    assert t.dense.groupBy("meter_id").count().select("count").distinct().collect()[0][0] == last + 1
    events.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert inputs(spark, str(tmp_path)) is not t


def test_scope_and_dead_tables(spark):
    scope = spark.createDataFrame([("1", "True"), ("2.0", " YES "), ("3", "sim"), ("4", "0"), ("5", None), ("6", "")], "meter_id string, process_in_next_script string")
    assert {r.meter_id: r.process for r in decisions.scope_decision(scope).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    flags = spark.createDataFrame([(1, True), (2, False)], "meter_id int, process_in_next_script boolean")
    assert [r.process for r in decisions.scope_decision(flags).orderBy("meter_id").collect()] == [True, False]
    with pytest.raises(ValueError, match="process_in_next_script"):
        decisions.scope_decision(scope.select("meter_id"))
    rows = [("8", "A", None, None), ("8", None, "p_b", None), ("8.0", "x", None, "M08-C"), ("7", None, "M07_a", None), ("7", None, "v_a", None), ("6", None, None, "M06"), (None, "a", None, None), ("8", "a", "p_a", None), ("?", "a", None, None)]
    dead = spark.createDataFrame(rows, "meter_id string, phase string, variable string, channel string")
    assert {tuple(r) for r in decisions.dead_power_channels(dead).collect()} == {(8, "a"), (8, "b"), (8, "c"), (7, "a")}
    assert decisions.dead_power_channels(dead.drop("meter_id")).count() == 0 == decisions.dead_power_channels(dead.select("meter_id")).count()
    assert {tuple(r) for r in decisions.dead_pairs(dead).collect()} == {(8, "p_b"), (7, "M07_a"), (7, "v_a"), (8, "p_a")}
    assert decisions.dead_pairs(dead.drop("variable")).count() == 0


def test_gap_rule_tables(spark):
    rule = spark.createDataFrame([("721", None, "4"), ("1", "60.0", "1"), ("61", "720", "2"), (None, "9", "1"), ("5", "6", None)], "min_min string, max_min string, n_porcoes string")
    assert decisions.gap_rule(rule) == [(1, 1, 60, 1), (2, 61, 720, 2), (3, 721, None, 4)]
    assert decisions.gap_rule(rule, 60) == [(1, 1, 1, 1), (2, 2, 12, 2), (3, 13, None, 4)]
    with pytest.raises(ValueError, match="no valid row"):
        decisions.gap_rule(rule.filter("min_min is null"))
    with pytest.raises(ValueError, match="max_min"):
        decisions.gap_rule(rule.drop("max_min"))
    with pytest.raises(ValueError, match="n_porcoes_onda"):
        decisions.gap_rule(rule.drop("n_porcoes"))
    with pytest.raises(ValueError, match="p_c"):
        decisions.require_power_columns(spark.createDataFrame([(1.0, 2.0)], "p_a double, p_b double"))


def test_neighbours_of_values_over_codes(spark):
    from voltloom.operators import ranks

    values = sorted({round(v, 3) for v in [-1000.0, -3.5, -1e-3, 0.0, 1e-3, 0.5, 0.75, 1.0, 1.001, 2.0, 3.0, 1e6]})
    df = spark.createDataFrame([(k, v, k + i + 1) for k in (1, 2) for i, v in enumerate(values)], "k int, v double, c long")
    for k in (1, 2):
        got = sorted((r.v, r.before, r.next and r.next.v) for r in ranks.beside(df, ["k"], "v", "c", ["v", "c"]).filter(f"k = {k}").collect())
        assert [g[0] for g in got] == values and [g[2] for g in got] == [*values[1:], None]
        assert [g[1] for g in got] == [sum(k + j + 1 for j in range(i)) for i in range(len(values))]
