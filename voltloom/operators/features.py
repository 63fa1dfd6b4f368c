"""Feature ranking and ablation on sums of products gathered in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed, ratio

GRAM = "output string, seg int, i int, j int, n double, a double, b double, s double"


def gram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pairwise complete sums over ``(features, target)`` per output and time segment, as ``(output, seg, i <= j, n, a, b, s)``.

    Of every two columns: rows that know both, the sums of either over them, and the sum of products. A missing cell costs the pairs of its
    column and not its row. Every task adds its rows up before the shuffle, so only matrices travel.
    """
    cols = [*features, target]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for key, part in b.groupby(["output", "seg"]):
                v = part[cols].to_numpy(float)
                known = np.isfinite(v)
                v, k = np.where(known, v, 0.0), known.astype(float)
                total[key] = total.get(key, 0.0) + np.stack([k.T @ k, v.T @ k, k.T @ v, v.T @ v])
        for (output, seg), g in total.items():
            i, j = np.triu_indices(g.shape[1])
            n, a, b_, s = (m[i, j] for m in g)
            yield pd.DataFrame({"output": output, "seg": seg, "i": i + 1, "j": j + 1, "n": n, "a": a, "b": b_, "s": s})

    rows = df.select("output", "seg", *cols)
    return rows.mapInPandas(add, GRAM).groupBy("output", "seg", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "s")])


def _sums(g: pd.DataFrame) -> np.ndarray:
    """The sums as four full matrices, row 0 left free; sums of several segments are their sums."""
    k = int(g["j"].max()) + 1
    out = np.zeros((4, k, k))
    i, j = g["i"].to_numpy(), g["j"].to_numpy()
    off = i != j
    for m, c in enumerate("nabs"):
        v = g[c].to_numpy()
        np.add.at(out[m], (i, j), v)
        np.add.at(out[{1: 2, 2: 1}.get(m, m)], (j[off], i[off]), v[off])
    return out


def _moments(sums: np.ndarray) -> np.ndarray:
    """Products of ``(1, columns)`` as a complete table of the target's rows would have them: means of each column, covariances of each pair."""
    n, a, b, s = sums
    known = np.maximum(np.diag(n), 1.0)
    mean = np.diag(a) / known
    pair = np.maximum(n, 1.0)
    m = np.where(n > 0, s / pair - (a / pair) * (b / pair), 0.0) + np.outer(mean, mean)
    m[0, 1:], m[1:, 0], m[0, 0] = mean[1:], mean[1:], 1.0
    return m * n[-1, -1]


def _matrix(g: pd.DataFrame) -> np.ndarray:
    return _moments(_sums(g))


def _solve(m: np.ndarray, use: Sequence[int]) -> np.ndarray:
    idx = [0, *use]
    a = m[np.ix_(idx, idx)]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
    return np.linalg.lstsq(a / np.outer(scale, scale), m[idx, -1] / scale, rcond=1e-10)[0] / scale


def _weight(m: np.ndarray, use: Sequence[int], coef: np.ndarray) -> np.ndarray:
    n = m[0, 0]
    var = np.maximum(m[use, use] / n - (m[0, use] / n) ** 2, 0.0)
    vy = max(m[-1, -1] / n - (m[0, -1] / n) ** 2, 1e-12)
    return np.abs(coef[1:]) * np.sqrt(var / vy)


def recursive_ranking(grams: DataFrame, features: Sequence[str], folds: int = 5, drop: int = 5) -> DataFrame:
    """Per output and feature: rank, standardised weight and whether it is in the best-sized set.

    The ``drop`` weakest features go at each step; the size is the one of least mean squared error over
    expanding folds. Both follow from the matrices of the segments 0..folds, which are small.
    """
    k = len(features)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {s: _sums(g) for s, g in pdf.groupby("seg")}
        segs = {s: _moments(m) for s, m in sums.items()}
        whole = _moments(sum(sums.values()))
        use, sizes, order = list(range(1, k + 1)), [], []
        while use:
            err = []
            for f in range(folds):
                train = _moments(sum((m for s, m in sums.items() if s <= f), np.zeros((4, k + 2, k + 2))))
                valid = segs.get(f + 1)
                if valid is None or train[0, 0] < 10:
                    continue
                c = _solve(train, use)
                v = np.r_[c, -1.0]
                idx = [0, *use, k + 1]
                err.append(float(v @ valid[np.ix_(idx, idx)] @ v) / valid[0, 0])
            sizes.append((np.mean(err) if err else np.inf, len(use), list(use)))
            w = _weight(whole, use, _solve(whole, use))
            weakest = [use[i] for i in np.argsort(w, kind="stable")[: min(drop, len(use))]]
            order = weakest[::-1] + order  # last to go, first in rank
            use = [u for u in use if u not in weakest]
        best = min(sizes, key=lambda t: (t[0], t[1]))
        full = _weight(whole, list(range(1, k + 1)), _solve(whole, list(range(1, k + 1))))
        pos = {u: r for r, u in enumerate(order, 1)}
        return pd.DataFrame({
            "output": pdf["output"].iloc[0], "feature": list(features), "rank": [pos[i] for i in range(1, k + 1)],
            "weight": full, "selected": [i in best[2] for i in range(1, k + 1)], "cv_mse": best[0], "best_size": best[1],
        })

    schema = "output string, feature string, rank int, weight double, selected boolean, cv_mse double, best_size int"
    return grams.groupBy("output").applyInPandas(rank, schema)


def global_importance(ranking: DataFrame) -> DataFrame:
    """Weights summed over the outputs with their cumulative share."""
    g = ranking.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count_if("selected").alias("n_selected"))
    w = Window.partitionBy().orderBy(F.desc("weight"), "feature")
    return g.withColumn("rank", F.row_number().over(w)).withColumn(
        "cum_pct", F.sum("weight").over(w) * 100.0 / F.sum("weight").over(Window.partitionBy())
    )


def by_correlation(df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, top: int) -> DataFrame:
    """``(keys, feature, r, rank)``: the ``top`` columns of largest absolute correlation with the target, from one aggregation.

    A column that does not vary has no correlation and is never selected.
    """
    def r(c: str) -> Column:
        y, v = F.when(F.col(c).isNotNull(), F.col(target)), F.when(F.col(target).isNotNull(), F.col(c))
        return ratio(F.covar_pop(y, v), F.stddev_pop(y) * F.stddev_pop(v))

    wide = df.groupBy(*keys).agg(*[r(c).alias(c) for c in columns])
    long = wide.unpivot(list(keys), list(columns), "feature", "r").withColumn("r", fixed(F.abs("r"), 6)).filter("r is not null")
    w = Window.partitionBy(*keys).orderBy(F.desc("r"), "feature")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def selection_frequency(selected: DataFrame, harmonic: Column) -> DataFrame:
    """Number of outputs that select each feature, and its type."""
    counts = selected.groupBy("feature").agg(F.count("*").alias("n_selected"))
    return counts.withColumn("type", F.when(harmonic, "harmonic").otherwise("fundamental"))


def candidate_sets(importance: DataFrame, knee: DataFrame, top: int = 48) -> DataFrame:
    """``(set, rank, feature)``: knee, 95 % share, union of the selected, the first ``top``, all."""
    j = importance.crossJoin(F.broadcast(knee.filter("is_knee").select(F.col("rank").alias("_knee"))))
    rules = {
        "knee": F.col("rank") <= F.col("_knee"), "n95": F.col("cum_pct") <= 95.0,
        "union": F.col("n_selected") > 0, f"top{top}": F.col("rank") <= top, "all": F.lit(True),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return j.select(F.explode(names).alias("set"), "rank", "feature")


def family_ablation(df: DataFrame, features: Sequence[str], target: str, configs: Mapping[str, Sequence[str]], train_segs: int) -> DataFrame:
    """Error of a least squares model on the later segments, per output and feature configuration."""
    pos = {f: i + 1 for i, f in enumerate(features)}
    plans = {name: [pos[f] for f in cols] for name, cols in configs.items()}
    k = len(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)
        rows = []
        for name, use in plans.items():
            c = np.zeros(k + 1)
            c[[0, *use]] = _solve(m, use)
            rows.append((pdf["output"].iloc[0], name, c.tolist(), (m[0, : k + 1] / max(m[0, 0], 1.0)).tolist()))
        return pd.DataFrame(rows, columns=["output", "config", "coef", "mean"])

    train = gram(df.filter(F.col("seg") < train_segs), features, target)
    coef = train.groupBy("output").applyInPandas(fit, "output string, config string, coef array<double>, mean array<double>")
    test = df.filter((F.col("seg") >= train_segs) & F.col(target).isNotNull())
    j = test.join(coef, "output")
    pred = F.col("coef")[0]
    for f, i in pos.items():
        pred = pred + F.col("coef")[i] * F.coalesce(F.col(f), F.col("mean")[i])  # what is missing is the column's mean in training
    return j.groupBy("output", "config").agg(
        (F.sum(F.abs(pred - F.col(target))) / (F.sum(F.abs(target)) + 1e-9) * 100.0).alias("nae")
    )
