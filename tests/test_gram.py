"""Blocked products of all members of a group against row-by-row comparison."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from voltloom.operators import gram, repair, scope

NAMES = ("i_an", "i_bn", "i_cn")


def frame(meters=11, steps=300, seed=2):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(3, steps)).cumsum(axis=1)
    rows = {}
    for m in range(1, meters + 1):
        for k, c in enumerate(NAMES):
            v = base[k] * (1 + 0.1 * (m % 4)) + draw.normal(size=steps) * (m % 3) + 1e6 * (m == 5)
            if m == 7:
                v = np.full(steps, 0.1)
            v[draw.random(steps) < 0.3] = np.nan
            if m == 9:
                v[48:96] = np.nan  # a tile may know nothing in a block
            rows[m, c] = v
    rows[2, "i_an"], rows[2, "i_bn"], rows[2, "i_cn"] = (rows[6, c].copy() for c in NAMES)
    return rows


def long_rows(rows):
    return [(m, c, x, None if math.isnan(v) else float(v)) for (m, c), values in rows.items() for x, v in enumerate(values)]


@pytest.mark.parametrize("tile", [64, 3])
def test_products_and_medians(spark, monkeypatch, tile):
    monkeypatch.setattr(gram, "TILE", tile)
    rows = frame()
    samples = spark.createDataFrame(long_rows(rows), "meter_id int, variable string, x long, value double").repartition(5)
    tiles = gram.tiled(samples, 48, 11).cache()
    sums = gram.fitted(gram.products(tiles, 48, classes=True)).cache()
    found = {(r.variable, r.a, r.b): r for r in sums.collect()}
    middle = {(r.variable, r.a, r.b): r for r in gram.medians(tiles, sums, 48, 11).collect()}
    assert len(found) == 3 * 55 == len(middle)
    for (c, a, b), r in found.items():
        x, y = rows[a, c], rows[b, c]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert r.n == both.sum()
        if 7 in (a, b):
            assert r.r is None
        else:
            assert r.r == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-7)
        assert (middle[c, a, b].ma, middle[c, a, b].mb) == pytest.approx((np.median(np.abs(x[both])), np.median(np.abs(y[both]))))


@pytest.mark.parametrize("tile", [64, 3])
def test_donors_and_cascade(spark, monkeypatch, tile):
    monkeypatch.setattr(gram, "TILE", tile)
    rows = frame(seed=3)
    samples = spark.createDataFrame(long_rows(rows), "meter_id int, variable string, x long, value double")
    targets = spark.createDataFrame([(9, "i_an"), (4, "i_bn")], "meter_id int, variable string")
    ranking = repair.donor_ranking(samples, targets, 48).cache()
    own, right = {}, {}
    for r in ranking.collect():
        own.setdefault((r.meter_id, r.variable), []).append((r.rank, r.donor, r.n))
    filled = {(r.meter_id, r.variable, r.x): (r.donor, r.recon) for r in repair.donor_cascade(samples, ranking, 1, 48).collect()}
    for m, c in ((9, "i_an"), (4, "i_bn")):
        fits = []
        for d in range(1, 12):
            x, y = rows[m, c], rows[d, c]
            both = ~np.isnan(x) & ~np.isnan(y)
            if d == m or both.sum() < 100 or np.std(x[both]) < 1e-9 or np.std(y[both]) < 1e-9 or np.mean(~np.isnan(y)) < 0.55:
                continue
            corr = np.corrcoef(x[both], y[both])[0, 1]
            if abs(corr) >= 0.5:
                fits.append((-round(abs(corr), 9), -d, int(both.sum()), np.polyfit(y[both], x[both], 1)))
        fits.sort(key=lambda f: f[:2])
        assert sorted(own[m, c]) == [(k + 1, -d, n) for k, (_, d, n, _) in enumerate(fits)]
        for x in np.flatnonzero(np.isnan(rows[m, c]) & ~np.isnan(rows[1, c])):
            for _, d, _, (a, b) in fits:
                if not math.isnan(rows[-d, c][x]):
                    right[m, c, int(x)] = (-d, a * rows[-d, c][x] + b)
                    break
    assert filled.keys() == right.keys()
    assert all(filled[k][0] == right[k][0] and filled[k][1] == pytest.approx(right[k][1], abs=1e-5) for k in right)


def test_ranking_keeps_pairs_below_the_gate(spark):
    from voltloom.plans import load_all
    from voltloom.plans.registry import ORACLES, QUERIES

    load_all()
    got = QUERIES["donor_ranking"](spark, "/root/testdata/sf0.01").collect()
    assert any(abs(r.r) < 0.02 for r in got) and all(r.accepted == (abs(r.r) >= 0.5) for r in got if abs(abs(r.r) - 0.5) > 1e-6)
    con = duckdb.connect()
    con.execute("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    sql = con.execute(ORACLES["donor_ranking"]).fetchall()
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 6), r[5], r[6])
    assert sorted(map(key, got)) == sorted(map(key, sql))


def test_ranking_ends_without_sorts_for_its_joins(spark):
    samples = spark.createDataFrame(long_rows(frame(seed=3)), "meter_id int, variable string, x long, value double")
    targets = spark.createDataFrame([(9, "i_an"), (4, "i_bn")], "meter_id int, variable string")
    plan = repair.donor_ranking(samples, targets, 48)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Sort [") == 1


def test_duplicates_beyond_a_tile(spark, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 2)
    rows = frame()
    wide = pd.DataFrame([{"meter_id": m, "x": x, **{c: rows[m, c][x] for c in NAMES}} for m in range(1, 12) for x in range(300)])
    df = spark.createDataFrame(wide.astype(object).where(wide.notna(), None).values.tolist(), "meter_id int, x long, i_an double, i_bn double, i_cn double")
    pairs = {(r.a, r.b): r for r in scope.duplicate_pairs(df, NAMES, 48).collect()}
    assert len(pairs) == 55 and not any(r.overlapping for k, r in pairs.items() if k != (2, 6))
    known = {m: ~np.isnan([rows[m, c] for c in NAMES]).any(axis=0) for m in range(1, 12)}
    assert all(r.overlap == (known[a] & known[b]).sum() for (a, b), r in pairs.items())


def test_empty(spark):
    none = spark.createDataFrame([], "meter_id int, x long, i_an double, i_bn double, i_cn double")
    assert scope.duplicate_pairs(none, NAMES, 48).collect() == []
