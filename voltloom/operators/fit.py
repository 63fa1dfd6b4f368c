"""Smallest change of scale that makes the quantities of a phase agree with physics, for all phases at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.operators import ranks
from voltloom.session import cut_lineage, stage

KEYS = ["meter_id", "phase"]
NAMES = ("a_v", "b_v", "a_i", "b_i", "a_s", "a_q")
# fixed values: start, bounds, penalty, robust width and status limits
START = (1.0, 0.0, 1.0, 0.0, 1.0, 1.0)
LOW = (0.5, -0.5, 0.5, -0.5, 0.5, 0.5)
HIGH = (2.0, 0.5, 2.0, 0.5, 2.0, 2.0)
PENALTY, DELTA = 0.10, 0.05
COMPATIBLE, INCOMPATIBLE, DISTANCE, MIN_POINTS = 0.05, 0.20, 0.20, 30
EPS = 1e-9


def residuals(theta: dict[str, Column]) -> dict[str, Column]:
    """Relative residuals of S = V I, P = S cos and S² = P² + Q² after rescaling."""
    vt = theta["a_v"] * F.col("v") + theta["b_v"] * F.col("med_v")
    it = theta["a_i"] * F.col("i") + theta["b_i"] * F.col("med_i")
    st, qt = theta["a_s"] * F.col("s"), theta["a_q"] * F.col("q")
    return {
        "vi": (st - vt * it) / (F.abs("s") + EPS),
        "pcos": (F.col("p") - st * F.col("cos")) / (F.abs("p") + EPS),
        "tri": (st * st - F.col("p") * F.col("p") - qt * qt) / (F.col("s") * F.col("s") + EPS),
    }


def slopes(theta: dict[str, Column]) -> dict[str, dict[int, Column]]:
    """Derivatives of the residuals by the parameters that move them."""
    vt = theta["a_v"] * F.col("v") + theta["b_v"] * F.col("med_v")
    it = theta["a_i"] * F.col("i") + theta["b_i"] * F.col("med_i")
    d1, d2, d3 = F.abs("s") + EPS, F.abs("p") + EPS, F.col("s") * F.col("s") + EPS
    return {
        "vi": {0: -F.col("v") * it / d1, 1: -F.col("med_v") * it / d1, 2: -vt * F.col("i") / d1, 3: -vt * F.col("med_i") / d1, 4: F.col("s") / d1},
        "pcos": {4: -F.col("s") * F.col("cos") / d2},
        "tri": {4: 2 * theta["a_s"] * F.col("s") * F.col("s") / d3, 5: -2 * theta["a_q"] * F.col("q") * F.col("q") / d3},
    }


def usable(wide: DataFrame) -> DataFrame:
    """One row per reading and phase with every quantity known and S > 0, beside the median magnitudes."""
    parts = [
        F.struct(F.lit(p.upper()).alias("phase"), F.col(f"v_{p}n").alias("v"), F.col(f"i_{p}n").alias("i"),
                 *[F.col(f"{q}_{p}").alias(q) for q in ("p", "q", "s", "cos")])
        for p in "abc"
    ]
    rows = wide.select("meter_id", "x", F.inline(F.array(*parts))).dropna().filter("s > 0")
    rows = rows.withColumn("_av", F.abs("v")).withColumn("_ai", F.abs("i"))
    v = ranks.quantiles(rows, KEYS, "_av", {"med_v": 0.5})
    i = ranks.quantiles(rows, KEYS, "_ai", {"med_i": 0.5}).drop("n")
    return rows.drop("_av", "_ai").join(v.join(i, KEYS), KEYS)


def median_residuals(rows: DataFrame, theta: dict[str, Column]) -> DataFrame:
    """Median absolute residual of each relation per phase."""
    r = rows.select(*KEYS, *[F.abs(c).alias(n) for n, c in residuals(theta).items()])
    long = r.unpivot(KEYS, ["vi", "pcos", "tri"], "term", "r")
    q = ranks.quantiles(long, [*KEYS, "term"], "r", {"med": 0.5})
    return q.groupBy(*KEYS).pivot("term", ["vi", "pcos", "tri"]).agg(F.first("med"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _step(theta: pd.Series, grad: pd.Series, curve: pd.Series) -> pd.Series:
    """Next parameters from averaged slopes: a damped least squares step inside the bounds."""
    up = np.triu_indices(6)
    out = []
    for t, g, c in zip(theta, grad, curve):
        t = np.asarray(t, float)
        h = np.zeros((6, 6))
        h[up] = c
        h = h + np.triu(h, 1).T + 2 * PENALTY * np.eye(6)
        g = np.asarray(g, float) + 2 * PENALTY * (t - np.array(START))
        free = ~(((t <= LOW) & (g > 0)) | ((t >= HIGH) & (g < 0)))
        d = np.zeros(6)
        d[free] = np.linalg.solve(h[np.ix_(free, free)], -g[free])
        out.append(np.clip(t + d, LOW, HIGH).tolist())
    return pd.Series(out)


def physical_fit(wide: DataFrame, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """Residuals before and after, parameters and status per meter and phase.

    Phases that already agree keep the identity. For the others each round joins the small parameter table to
    the readings, averages the robust slopes in one aggregation and takes one step, for all phases together. A phase
    whose largest step is below the tolerance is done and leaves; one that is not after the last round is marked ``NOT_CONVERGED``.
    """
    rows = stage(usable(wide))
    fixed_theta = {n: F.lit(v) for n, v in zip(NAMES, START)}
    before = stage(median_residuals(rows, fixed_theta))
    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("n_real"))
    need = before.join(sizes, KEYS).filter((F.greatest("vi", "pcos", "tri") > COMPATIBLE) & (F.col("n_real") >= MIN_POINTS))
    moving = cut_lineage(need.select(*KEYS, F.array(*[F.lit(v) for v in START]).alias("theta")))
    settled = None
    named = {n: F.col("theta")[i] for i, n in enumerate(NAMES)}
    res, der = residuals(named), slopes(named)
    weight = {k: F.when(F.abs(r) <= DELTA, F.lit(1.0)).otherwise(F.lit(DELTA) / F.abs(r)) for k, r in res.items()}
    zero = F.lit(0.0)
    grad = [sum((weight[k] * res[k] * d[a] for k, d in der.items() if a in d), zero) for a in range(6)]
    curve = [
        sum((weight[k] * d[a] * d[b] for k, d in der.items() if a in d and b in d), zero) for a in range(6) for b in range(a, 6)
    ]
    for _ in range(rounds):
        g = rows.join(moving, KEYS).groupBy(*KEYS, "theta").agg(
            F.array(*[F.avg(c) for c in grad]).alias("g"), F.array(*[F.avg(c) for c in curve]).alias("c")
        )
        went = F.array_max(F.zip_with("theta", "next", lambda a, b: F.abs(a - b)))
        after = cut_lineage(g.withColumn("next", _step("theta", "g", "c")).select(*KEYS, F.col("next").alias("theta"), (went < tolerance).alias("converged")))
        done = after.filter("converged")
        settled = done if settled is None else settled.unionByName(done)
        moving = after.filter("not converged").drop("converged")
        if moving.isEmpty():
            break
    theta = settled.unionByName(moving.withColumn("converged", F.lit(False)))
    moved = median_residuals(rows.join(theta, KEYS), named).withColumnsRenamed({c: f"{c}_after" for c in ("vi", "pcos", "tri")})
    out = wide.select("meter_id").distinct().withColumn("phase", F.explode(F.array(*[F.lit(p) for p in "ABC"])))
    out = out.join(sizes, KEYS, "left").join(before, KEYS, "left").join(moved, KEYS, "left").join(theta, KEYS, "left")
    out = out.withColumn("fitted", F.col("theta").isNotNull()).withColumn("n_real", F.coalesce("n_real", F.lit(0)))
    out = out.withColumn("theta", F.coalesce("theta", F.array(*[F.lit(v) for v in START])))
    dist = F.sqrt(sum(((F.col("theta")[i] - v) * (F.col("theta")[i] - v) for i, v in enumerate(START)), zero))
    worst = F.greatest(*[F.coalesce(f"{c}_after", c) for c in ("vi", "pcos", "tri")])
    out = out.withColumn("distance", dist).withColumn("worst_after", worst)
    status = (
        F.when(F.col("n_real") < MIN_POINTS, "DEAD_OR_INSUFFICIENT").when(F.col("fitted") & ~F.coalesce("converged", F.lit(True)), "NOT_CONVERGED").when(F.col("worst_after") > INCOMPATIBLE, "INCOMPATIBLE_PERSISTENT")
        .when((F.col("worst_after") <= COMPATIBLE) & (F.col("distance") <= DISTANCE), "COMPATIBLE").otherwise("ALERT")
    )
    return out.select(*KEYS, "n_real", "vi", "pcos", "tri", "fitted", *[F.col("theta")[i].alias(n) for i, n in enumerate(NAMES)], "distance", "worst_after", F.coalesce("converged", F.lit(True)).alias("converged"), status.alias("status"))
