"""Properties of the fill, the repair, the ranking and the stream."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom import session
from voltloom.operators import features, fill, fit, repair, seq
from voltloom.plans.q_fill import BANDS
from voltloom.plans.registry import inputs
from voltloom.streaming.windows import stream_grid


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    rows = []
    for m in (1, 2, 3):
        v = 10 * m + np.sin(np.arange(300) / 5) + rng.normal(0, 0.2, 300)
        holes = {1: [(0, 5), (40, 41), (60, 66), (100, 140), (290, 299)], 2: [(20, 20), (200, 230)], 3: [(0, 292)]}[m]
        miss = {x for a, b in holes for x in range(a, b + 1)}
        rows += [(m, "p_a", x, None if x in miss else float(v[x])) for x in range(300)]
    return spark.createDataFrame(rows, "meter_id int, variable string, x long, value double").cache()


def collect(df):
    return {(r.meter_id, r.x): (r.observed, r.value, r.code, r.kind) for r in df.collect()}


def test_fill_properties_and_partition_invariance(spark, samples):
    got = collect(fill.analog_fill(samples, BANDS, 64))
    assert len(got) == 900
    for m in (1, 2):
        obs = [o for (k, _), (o, *_r) in got.items() if k == m and o is not None]
        span = max(max(obs) - min(obs), np.std(obs))
        for (k, _), (o, v, code, kind) in got.items():
            if k != m:
                continue
            assert v is not None and (o is None or v == o)
            assert min(obs) - 0.05 * span - 1e-9 <= v <= max(obs) + 0.05 * span + 1e-9
            assert (code == 0) == (o is not None)
    assert {got[(1, x)][2] for x in (40, 41)} == {1}
    assert got[(1, 120)][2] in (4, 6)
    assert all(got[(3, x)][1] is None for x in range(293))  # seven readings: too few, left alone
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = collect(fill.analog_fill(samples.repartition(5), BANDS, 64))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {k: (round(v[1], 6) if v[1] is not None else None, v[2:]) for k, v in got.items()} == {
        k: (round(v[1], 6) if v[1] is not None else None, v[2:]) for k, v in again.items()
    }


def test_older_method_fills_everything(samples):
    out = fill.analog_fill(samples.filter("meter_id = 2"), BANDS, 64, backbone="line", criteria="freq")
    assert out.filter("value is null").count() == 0


def test_fragment_index_offers_each_admissible_start(spark):
    runs = [(1, "p_a", 0, 4, 5), (1, "p_a", 10, 11, 2), (1, "p_a", 100, 399, 300), (1, "p_a", 500, 507, 8), (2, "p_a", 7, 12, 6)]
    library = spark.createDataFrame(runs, "meter_id int, variable string, x0 long, x1 long, n long")
    lengths = spark.createDataFrame([(1, "p_a", 6), (1, "p_a", 3), (2, "p_a", 6), (2, "p_a", 7)], "meter_id int, variable string, len long")
    index = fill.fragment_index(library, lengths, 64)
    draws = spark.range(700).selectExpr("id as draw").crossJoin(lengths)
    found = {}
    for r in fill.select_starts(draws, index).collect():
        found.setdefault((r.meter_id, r.len), {}).setdefault(r.pick, set()).add(r.start)
    for m, k in ((1, 6), (1, 3), (2, 6)):
        right = {s for i, _, a, b, _ in runs if i == m for s in range(a, b - k + 2)}
        own = found[m, k]
        assert all(len(s) == 1 for s in own.values()) and len(own) == len(right)
        assert {x for s in own.values() for x in s} == right
    assert (2, 7) not in found  # no run is long enough


@pytest.mark.parametrize("block", [16, 64, 1000])
def test_half_step_scan_across_blocks(spark, block):
    draw = np.random.default_rng(block)
    rows, right = [], {}
    for m in range(1, 6):
        known = draw.random(500) < (0.5 + 0.1 * m if m < 5 else 2)
        known[100 : 100 + 60 * m] = True
        seen = known & (draw.random(500) < 0.9)
        rows += [(m, "p_a", x, float(x) if known[x] else None, "obs" if seen[x] else "micro" if known[x] else None) for x in range(500)]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(int), [0]])))
        for plen in (3, 7, 10, 16):
            right[m, plen] = 0
            for a, b in zip(edge[::2], edge[1::2]):
                p = a
                while p + plen <= b:
                    good = seen[p : p + plen].mean() >= 0.85
                    right[m, plen] += good
                    p += plen if good else max(1, plen // 2)
    df = spark.createDataFrame(rows, "meter_id int, variable string, x long, value double, origin string")
    need = spark.createDataFrame([(m, "p_a", p) for m, p in right], "meter_id int, variable string, plen long")
    tables = fill.scan_tables(seq.arrays(df, fill.CH, ["value", "origin"], block=block), need, block)
    assert {(r.meter_id, r.plen): r.cap for r in fill.capacity(tables).collect()} == right


def test_cut_takes_pieces_over_block_borders(spark):
    df = spark.range(100).selectExpr("1 as m", "id as x", "if(id % 7 = 0, null, id * 2) as v").repartition(4)
    blocks = seq.arrays(df, ["m"], ["v"], block=8)
    pieces = [(1, 0, 0), (2, 5, 30), (3, 95, 140), (4, 8, 15), (5, 9, 8), (6, 120, 130)]
    got = {r.id: r.v for r in seq.cut(spark.createDataFrame([(1, *p) for p in pieces], "m int, id int, a long, b long"), ["m", "id"], ["m"], blocks, "v", 8).collect()}
    assert got == {i: [None if x % 7 == 0 else 2 * x for x in range(a, min(b, 99) + 1)] for i, a, b in pieces if a <= min(b, 99)}


def test_edges_are_tiled_by_remainder(spark):
    values = [None] * 9 + [1.0, 4.0, None, 2.0, 7.0, 5.0] + [3.0] * 10 + [None] * 4
    df = spark.createDataFrame([(1, "p_a", x, v, "obs" if v is not None else None) for x, v in enumerate(values)], "meter_id int, variable string, x long, value double, origin string")
    gaps = fill.portions(fill.bordered_gaps(df, 8), BANDS)
    got = {r.x: (r.cand, r.kind) for r in fill.edge_points(gaps, df, 8).collect()}
    src = [v for v in values[9:18] if v is not None]
    tiled = [src[o % len(src)] for o in range(9)]
    for o in range(9):
        assert got[o] == (pytest.approx(1.0 + tiled[o] - (tiled[0] + (tiled[-1] - tiled[0]) * o / 8)), "analog")
    assert [got[x] for x in range(25, 29)] == [(3.0, "edge")] * 4  # a flat stretch has no texture
    assert 11 not in got  # an inner gap is none of these


def test_repair_keeps_the_envelope(spark):
    vals = [math.sin(x / 3) + (30.0 if x in (70, 90, 91, 92, 93) else 0.0) for x in range(200)]
    df = spark.createDataFrame([(1, "p_a", x, v) for x, v in enumerate(vals)], "meter_id int, variable string, x long, value double")
    env = repair.reference_envelope(df, 0, 50)
    lo, hi = env.first().lower, env.first().upper
    out = {r.x: r.value for r in repair.apply_repair(df, env, 0, 50, 199, 64).collect()}
    assert all(lo - 1e-9 <= v <= hi + 1e-9 for v in out.values()) and len(out) == 200
    assert out[70] == pytest.approx(hi) and out[10] == vals[10] and out[60] == vals[60]


def test_ranking_finds_planted_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 8))
    y = 3 * x[:, 2] - 2 * x[:, 5] + 0.1 * rng.normal(size=240)
    names = [f"f{i}" for i in range(8)]
    rows = [("o", int(k // 40), *map(float, x[k]), float(y[k])) for k in range(240)]
    df = spark.createDataFrame(rows, "output string, seg int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    g = features.gram(df, names, "y")
    exact = {(r.i, r.j): r.s for r in g.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    m = np.column_stack([np.ones(240), x, y])
    assert exact[(3, 9)] == pytest.approx((m.T @ m)[3, 9])
    r = {r.feature: r for r in features.recursive_ranking(g, names, drop=2).collect()}
    assert {f for f, v in r.items() if v.rank <= 2} == {"f2", "f5"} and r["f2"].selected and r["f5"].selected
    a = {r.config: r.nae for r in features.family_ablation(df, names, "y", {"both": ["f2", "f5"], "one": ["f2"]}, 5).collect()}
    assert a["both"] < 10 < a["one"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(m, f"2024-01-01 0{h}:{mi:02d}:00", float(h * m)) for m in (1, 2) for h in range(4) for mi in range(0, 60, 20)]
    df = spark.createDataFrame(rows, "meter_id int, t string, p_a double").select("meter_id", F.to_timestamp("t").alias("time"), "p_a")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_grid(stream, ["p_a"], "1 hour", "10 minutes", "p_a").writeStream.format("memory").queryName("grid_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.meter_id, r.start, r.n, r.p_a, r.kwh) for r in d.collect())
    assert key(spark.table("grid_out")) == key(stream_grid(df, ["p_a"], "1 hour", "10 minutes", "p_a"))


def test_physical_fit_is_a_bounded_minimum(spark):
    rng = np.random.default_rng(4)
    n = 120
    v, i, c = 220 + rng.normal(0, 3, n), 5 + rng.random(n), 0.8 + 0.1 * rng.random(n)
    s = v * i
    cols = {}
    for ph, scale in (("a", 1.0), ("b", 1.15), ("c", 1.0)):
        q = s * np.sqrt(1 - c * c) * (1.5 if ph == "c" else 1.0)
        cols |= {f"v_{ph}n": v, f"i_{ph}n": i, f"p_{ph}": s * c, f"q_{ph}": q, f"s_{ph}": s * scale, f"cos_{ph}": c}
    rows = [(1, k, *[float(a[k]) for a in cols.values()]) for k in range(n)]
    df = spark.createDataFrame(rows, "meter_id int, x long, " + ", ".join(f"{k} double" for k in cols))
    got = {r.phase: r for r in fit.physical_fit(df).collect()}
    assert not got["A"].fitted and got["A"].status == "COMPATIBLE"

    def objective(ph, t):
        V, I, P, Q, S, C = (cols[k.format(p=ph)] for k in ("v_{p}n", "i_{p}n", "p_{p}", "q_{p}", "s_{p}", "cos_{p}"))
        vt, it, st, qt = t[0] * V + t[1] * np.median(V), t[2] * I + t[3] * np.median(I), t[4] * S, t[5] * Q
        total = fit.PENALTY * np.sum((np.array(t) - fit.START) ** 2)
        for r in ((st - vt * it) / S, (P - st * C) / P, (st**2 - P**2 - qt**2) / S**2):
            a = np.abs(r)
            total += np.where(a <= fit.DELTA, r * r / 2, fit.DELTA * (a - fit.DELTA / 2)).mean()
        return total

    for ph in "bc":
        r = got[ph.upper()]
        t = np.array([r[k] for k in fit.NAMES])
        best = objective(ph, t)
        assert r.fitted and best < objective(ph, np.array(fit.START))
        for _ in range(300):
            near = np.clip(t + rng.normal(0, 0.02, 6), fit.LOW, fit.HIGH)
            assert objective(ph, near) >= best - 1e-5


def test_islands_cover_the_hole(spark):
    rng = np.random.default_rng(5)
    rows = [(1, "p_a", x, None if 80 <= x < 130 or x % 40 == 0 else float(50 + rng.normal())) for x in range(200)]
    df = spark.createDataFrame(rows, "meter_id int, variable string, x long, value double")
    hole = spark.createDataFrame([(1, "p_a", 80, 129)], "meter_id int, variable string, x0 long, x1 long")
    out = {r.x: r.value for r in repair.island_overlap_add(df, hole, 32).collect()}
    assert sorted(out) == list(range(80, 130)) and all(40 < v < 60 for v in out.values())


def test_defragment_chains_donors_and_islands(spark):
    rng = np.random.default_rng(4)
    base = 20 + np.sin(np.arange(400) / 9) + rng.normal(0, 0.1, 400)
    main = rng.normal(0, 1, 400)
    main[300:320] = np.nan
    donor = base * 2 + 1
    donor[100:140] = np.nan
    target = base.copy()
    target[np.arange(400) % 4 == 0] = np.nan
    target[100:140] = np.nan
    lonely = rng.normal(0, 1, 400)
    lonely[np.arange(400) % 3 == 0] = np.nan
    rows = [(m, "p_a", x, None if math.isnan(v[x]) else float(v[x])) for m, v in enumerate((main, donor, target, lonely), 1) for x in range(400)]
    df = spark.createDataFrame(rows, "meter_id int, variable string, x long, value double").repartition(3)
    got = {(r.meter_id, r.x): (r.value, r.origin) for r in repair.defragment(df, 1, 64).collect()}
    assert {m for m, _ in got} == {3, 4} and {o for (m, _), (_, o) in got.items() if m == 4} == {"observed", "no_donor"}
    for x in range(400):
        v, origin = got[3, x]
        if not math.isnan(target[x]):
            assert (v, origin) == (target[x], "observed")
        elif math.isnan(main[x]):
            assert (v, origin) == (None, "none")
        elif not math.isnan(donor[x]):
            assert origin == "donor" and v == pytest.approx(base[x], abs=1e-6)
        else:
            assert origin == "islands" and 17 < v < 23


def test_island_overlap_add_over_a_hole_longer_than_a_block(spark):
    values = [float(x % 5) for x in range(40)] + [None] * 100 + [2.0] * 3
    df = spark.createDataFrame([(1, "p_a", x, v) for x, v in enumerate(values)], "meter_id int, variable string, x long, value double")
    holes = spark.createDataFrame([(1, "p_a", 40, 139)], "meter_id int, variable string, x0 long, x1 long")
    one, other = ({r.x: r.value for r in repair.island_overlap_add(df, holes, b).collect()} for b in (16, 500))
    assert one.keys() == set(range(40, 140)) and one == pytest.approx(other)


def test_gram_is_pairwise_complete(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = 3 * x[:, 0] - 2 * x[:, 2] + 0.01 * rng.normal(size=400)
    x[rng.random((400, 3)) < 0.4] = np.nan
    rows = [("G", k * 6 // 400, *[None if math.isnan(v) else float(v) for v in x[k]], float(y[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "output string, seg int, f1 double, f2 double, f3 double, y double").repartition(3)
    g = features.gram(df, ["f1", "f2", "f3"], "y").toPandas()
    whole = np.column_stack([x, y])
    for i in range(4):
        for j in range(i, 4):
            both = np.isfinite(whole[:, i]) & np.isfinite(whole[:, j])
            r = g[(g.i == i + 1) & (g.j == j + 1)][["n", "a", "b", "s"]].sum()
            assert r.tolist() == pytest.approx([both.sum(), whole[both, i].sum(), whole[both, j].sum(), (whole[both, i] * whole[both, j]).sum()])
    ranked = {r.feature: r for r in features.recursive_ranking(features.gram(df, ["f1", "f2", "f3"], "y"), ["f1", "f2", "f3"], drop=1).collect()}
    assert [f for f in sorted(ranked, key=lambda f: ranked[f]["rank"])] == ["f1", "f3", "f2"]  # a row in five is complete
    plain = features.family_ablation(df, ["f1", "f2", "f3"], "y", {"all": ["f1", "f2", "f3"], "none": []}, 5)
    nae = {r.config: r.nae for r in plain.collect()}
    assert nae["all"] < nae["none"]


def test_heldout_sizes_are_series_of_their_own(spark, samples):
    win = fill.heldout_windows(samples, (3, 12), 1.0, 7).cache()
    rows = win.collect()
    truth = {(r.meter_id, r.x): r.value for r in samples.collect()}
    for r in rows:
        assert r.x1 - r.x0 + 1 == r.size and r.x0 // r.size % 2 == 1 and r.n_obs >= r.size / 2
        assert truth[r.meter_id, r.x0 - 1] is not None and truth[r.meter_id, r.x1 + 1] is not None
        assert r.n_obs == sum(truth[r.meter_id, x] is not None for x in range(r.x0, r.x1 + 1))
    masked = {(r.meter_id, r.variable, r.x): r.value for r in fill.hide(samples, win).collect()}
    gone = {(r.meter_id, f"p_a@{r.size}", x) for r in rows for x in range(r.x0, r.x1 + 1)}
    assert {v for _, v, _ in masked} == {"p_a@3", "p_a@12"}
    assert all(v == (None if k in gone else truth[k[0], k[2]]) for k, v in masked.items())


def test_scores_of_a_perfect_and_a_flat_fill(spark, samples):
    win = fill.heldout_windows(samples, (12,), 1.0, 7)
    named = samples.withColumn("variable", F.lit("p_a@12"))
    same = fill.fill_scores(samples, named, win, "same").collect()
    assert all(r.sd_ratio == pytest.approx(1) and r.freq_ratio in (None, 1.0) and r.mae == 0 and r.ks_d == 0 for r in same)
    flat = fill.fill_scores(samples, named.withColumn("value", F.lit(5.0)), win, "flat")
    assert all(r.sd_ratio == pytest.approx(0) and r.freq_ratio in (None, 0.0) and r.ks_d == 1 for r in flat.collect())
    tests = {r.metric: r for r in fill.method_tests(flat.unionByName(fill.fill_scores(samples, named, win, "same")), "flat", "same").collect()}
    assert tests.keys() == {"sd", "freq", "energy", "mae"} and all(r.mean_diff > 0 and r.p_holm >= r.p_value for r in tests.values())


def test_rows_in_small_files_are_not_broadcast(spark):
    inputs(spark, "/root/testdata/sf0.001")
    many = spark.range(1_000_000).selectExpr("cast(id % 8 as int) as meter_id", "'p_a' as variable", "id as x")
    big, other, few = session.stage(many), session.stage(many), session.stage(many.limit(20))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    joins = [plan(big.join(t, ["meter_id", "variable", "x"])) for t in (other, few)]
    session.prepare(spark)
    assert "Broadcast" not in joins[0] and "Broadcast" in joins[1]
    assert "Broadcast" in plan(session.stage(many).join(session.stage(many), ["meter_id", "variable", "x"]))  # Spark's own measure


def test_a_constant_window_has_no_spread_ratio(spark):
    values = [0.196197, 0.1, 0.7, 1.1, 3.3, 5.7, 0.3]
    rows = [(m, "p_a", x, v) for m, v in enumerate(values) for x in range(24)]
    truth = spark.createDataFrame(rows, "meter_id int, variable string, x long, value double").repartition(7, "x")
    windows = spark.createDataFrame([(24, m, "p_a", 0, 23) for m in range(len(values))], "size int, meter_id int, variable string, x0 long, x1 long")
    filled = truth.withColumn("variable", F.lit("p_a@24")).withColumn("value", F.col("x").cast("double"))
    apart = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in apart.items():
        spark.conf.set(k, v)
    try:
        got = fill.fill_scores(truth, filled, windows, "linear").select("sd_ratio").collect()
    finally:
        for k in apart:
            spark.conf.unset(k)
    assert [r.sd_ratio for r in got] == [None] * len(values)
