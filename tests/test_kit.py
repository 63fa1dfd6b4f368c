"""Sequence and rank kits against plain Python on small inputs; block sizes force stitching."""

from __future__ import annotations

import random
import statistics as st
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.functions.slopes import theil_sen
from voltloom.operators import aggregate, joins, ranks, seq, statistics

ROOT = Path(__file__).resolve().parents[1]


def series(spark, masks):
    rows = [(k, x, bool(b)) for k, m in enumerate(masks) for x, b in enumerate(m)]
    return spark.createDataFrame(rows, "k int, x long, f boolean")


def plain_runs(mask, bridge=0):
    out, x = [], 0
    while x < len(mask):
        if mask[x]:
            y = x
            while y + 1 < len(mask) and mask[y + 1]:
                y += 1
            if out and x - out[-1][1] - 1 <= bridge:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
            x = y + 1
        else:
            x += 1
    return out


MASKS = [
    [0] * 40, [1] * 40, [1, 0] * 20, [0] * 7 + [1] * 25 + [0] * 8, [1] + [0] * 38 + [1],
    [random.Random(5).random() < 0.4 for _ in range(40)], [random.Random(6).random() < 0.85 for _ in range(40)],
]


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
@pytest.mark.parametrize("bridge", [0, 3, 9])
def test_runs_and_bridges(spark, block, bridge):
    df = series(spark, MASKS)
    got = seq.close_gaps(df, ["k"], F.col("f"), bridge, block=block)
    found = sorted((r.k, r.x0, r.x1) for r in got.collect())
    want = sorted((k, a, b) for k, m in enumerate(MASKS) for a, b in plain_runs(m, bridge))
    assert found == want


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_frames_carry_and_running(spark, block):
    rnd = random.Random(1)
    vals = [None if rnd.random() < 0.6 else float(rnd.randint(0, 9)) for _ in range(50)]
    df = spark.createDataFrame([(1, x, v) for x, v in enumerate(vals)], "k int, x long, v double")
    filled = {r.x: r.o for r in seq.interpolate(df, ["k"], "v", "o", block=block).collect()}
    known = [x for x, v in enumerate(vals) if v is not None]
    want = np.interp(range(50), known, [vals[x] for x in known])
    assert [filled[x] for x in range(50)] == pytest.approx(list(want))
    tot = {r.x: r.s for r in seq.running(df, ["k"], {"s": F.coalesce("v", F.lit(0.0))}, block=block).collect()}
    assert [tot[x] for x in range(50)] == list(np.cumsum([v or 0.0 for v in vals]))
    med = {r.x: r.m for r in seq.rolling_median(df, ["k"], "v", "m", 4, 3, block=block).collect()}
    for x in range(50):
        near = [v for v in vals[max(0, x - 4): x + 5] if v is not None]
        assert med[x] == (st.median(near) if len(near) >= 3 else None)


def test_quantiles_spread_equals_builtin(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), rnd.gauss(500, 0.01), 0.0, -3.0, 1e9])) for g in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, v double")
    marks = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    for r in ranks.quantiles(df, ["g"], "v", marks).collect():
        own = [v for g, v in rows if g == r.g]
        assert [r[m] for m in marks] == pytest.approx(list(np.quantile(own, list(marks.values()))))
    one = ranks.quantiles(df, [], "v", {"m": 0.5}).first()
    assert one.n == len(rows)


def test_longest_equal_run(spark):
    vals = [1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3, 1, 1, 1, 1, 1, 1, 1, 1, 2]
    df = spark.createDataFrame([(1, x, float(v)) for x, v in enumerate(vals)], "k int, x long, v double")
    for block in (1, 3, 5, 100):
        assert aggregate.longest_equal_run(df, ["k"], "v", block=block).first().longest == 8


def test_components_on_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id"))
    edges = spark.range(59).filter("id <> 30").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.component for r in joins.connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_r2_drops_a_dependent_regressor(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=80), rng.normal(size=80)
    y = 2 * a - b + rng.normal(size=80)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b, a + b)], "y double, a double, b double, s double")
    got = aggregate.r2_multi(df, [], F.col("y"), [F.col("a"), F.col("b"), F.col("s")]).first().r2
    m = np.column_stack([a, b, np.ones(80)])
    res = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    assert got == pytest.approx(1 - (res**2).sum() / ((y - y.mean()) ** 2).sum())


def test_theil_sen_and_p_values(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 30.0, 4.0],), ([5.0],), ([None, 1.0, 3.0],)], "a array<double>")
    assert [r.s for r in df.select(theil_sen("a").alias("s")).collect()][:2] == [1.0, 0.0]
    p = spark.createDataFrame([(0.0, 5, 0.0), (7.0, 5, 0.0)], "w double, n int, t double")
    got = [r.p for r in p.select(statistics.wilcoxon_p("w", "n", "t").alias("p")).collect()]
    assert got == pytest.approx([0.0625, 1.0])
    s = spark.createDataFrame([(2.228139, 10), (0.0, 3)], "t double, n int")
    got = [r.p for r in s.select(statistics.student_p("t", "n").alias("p")).collect()]
    assert got == pytest.approx([0.05, 1.0], abs=1e-4)


def test_p_of_few_pairs_is_exact_with_ties(spark):
    # -1, 2, 2 and 3..11 (signs as given): ranks 1, 2.5, 2.5, 4..12
    rows = [("one", float(d)) for d in (1, 2, 2, *range(3, 12))] + [("two", float(d)) for d in (-1, 2, -2, *range(3, 12))]
    got = {r.k: r for r in statistics.wilcoxon(spark.createDataFrame(rows, "k string, d double"), ["k"], "d").collect()}
    assert (got["one"].w, got["two"].w) == (0.0, 3.5)
    assert got["one"].p_value == pytest.approx(2 / 4096)
    assert got["two"].p_value == pytest.approx(2 * 5 / 4096)  # subsets of 1..12 with a sum of 3 at most


def test_permuted_rows_are_permutations(spark):
    rows = [(k, o, n, float(o), float(-o)) for k, n in ((1, 10), (2, 7919), (3, 1)) for o in range(n)]
    df = spark.createDataFrame(rows, "k int, ordinal long, n_all long, v double, w double")
    got = statistics.permuted(df, ["k"], ["v", "w"], 2).collect()
    assert len(got) == 2 * len(rows)
    for k, n in ((1, 10), (2, 7919), (3, 1)):
        for rep in (0, 1):
            own = [r for r in got if r.k == k and r.rep == rep]
            assert sorted(r.other.v for r in own) == list(map(float, range(n))) and all(r.other.w == -r.other.v for r in own)
            assert n == 1 or any(r.other.v != r.v for r in own)


def test_permutation_importance_of_one_join(spark):
    rows = [(1, o, 50, float(o % 7), float(o % 5), float(o % 7) * 2) for o in range(50)]
    df = spark.createDataFrame(rows, "k int, ordinal long, n_all long, a double, b double, y double")
    predict = {"y": lambda get: get("a") * (1 + get("b") * 0)}
    got = {r.grp: r for r in statistics.permutation_importance(df, ["k"], {"a": ["a"], "b": ["b"]}, predict, {"y": "y"}, 3).collect()}
    assert got.keys() == {"a", "b"} and got["b"].importance == 0.0 and got["a"].importance == pytest.approx(0.0)  # a sum over all rows is kept



def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_selection_by_correlation(spark):
    import pandas as pd

    from voltloom.operators import features

    rows = [("o1", float(i), float(-i), 1.0, None if i % 3 else float(i * i % 7)) for i in range(30)]
    rows += [("o2", float(i * i % 11), float(i), 1.0, float(i * i % 11) + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "output string, y double, a double, flat double, c double")
    got = {(r.output, r.feature): (r.r, r["rank"]) for r in features.by_correlation(df, ["output"], ["a", "flat", "c"], "y", 1).collect()}
    p = pd.DataFrame(rows, columns=["output", "y", "a", "flat", "c"])
    assert set(got) == {("o1", "a"), ("o2", "c")}
    for (o, f), (r, rank) in got.items():
        part = p[p.output == o]
        assert rank == 1 and abs(r - abs(part.y.corr(part[f]))) < 1e-6
    all_of = features.by_correlation(df, ["output"], ["a", "flat", "c"], "y", 3)
    counts = {r.feature: (r.n_selected, r.type) for r in features.selection_frequency(all_of, all_of.feature == "c").collect()}
    assert counts == {"a": (2, "fundamental"), "c": (2, "harmonic")}


def test_student_tail(spark):
    from pyspark.sql import functions as F

    from voltloom.operators import statistics

    # known two-sided tails: t = tan(pi/4) at one degree, closed form at two, the 5 % points at 8 and 28
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (2.0, 2.0, 1 - 2 / 6**0.5), (2.306004, 8.0, 0.05), (2.048407, 28.0, 0.05)], "t double, k double, p double")
    worst = df.select(F.max(F.abs(statistics.student_p("t", F.col("k")) - F.col("p")))).first()[0]
    assert worst < 1e-6
