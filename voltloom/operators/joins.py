"""Joins of series, roles and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.numeric import safe_corr
from voltloom.session import cut_lineage

Keys = Sequence[str]


def with_dim(df: DataFrame, dim: DataFrame, on: Keys, missing: Mapping[str, str] | None = None) -> DataFrame:
    """Left join with a table of roles or classes; unmatched rows get the given words.

    The side to ship is left to the optimizer, which knows its size.
    """
    return df.join(dim, list(on), "left").na.fill(dict(missing or {}))


def scope(df: DataFrame, allowed: DataFrame, on: Keys, broadcast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows inside and outside a set of keys."""
    ids = F.broadcast(allowed) if broadcast else allowed
    return df.join(ids, list(on), "left_semi"), df.join(ids, list(on), "left_anti")


def common_instants(samples: DataFrame, a: int, b: int) -> DataFrame:
    """Two meters side by side on the instants where both hold a value."""
    known = samples.filter("value is not null")
    left = known.filter(F.col("meter_id") == a).select("variable", "x", F.col("value").alias("value_a"))
    right = known.filter(F.col("meter_id") == b).select("variable", "x", F.col("value").alias("value_b"))
    return left.join(right, ["variable", "x"])


def model_pairs(df: DataFrame, on: Keys, model: str, value: str) -> DataFrame:
    """Every pair of models per key; the pairs themselves are the result (models are few by nature)."""
    a = df.select(*on, F.col(model).alias(f"{model}_a"), F.col(value).alias(f"{value}_a"))
    b = df.select(*on, F.col(model).alias(f"{model}_b"), F.col(value).alias(f"{value}_b"))
    return a.join(b, list(on)).filter(F.col(f"{model}_a") < F.col(f"{model}_b"))


def band_lookup(df: DataFrame, value: str, bands: Sequence[tuple]) -> DataFrame:
    """Category and portions of a length from ``(category, lo, hi, portions)`` bands, the last one open."""
    category, portions = F.lit(None).cast("int"), F.lit(None).cast("int")
    for cat, lo, hi, n in reversed(bands):
        inside = F.col(value) >= lo
        if hi is not None:
            inside = inside & (F.col(value) <= hi)
        category = F.when(inside, F.lit(cat)).otherwise(category)
        portions = F.when(inside, F.lit(n)).otherwise(portions)
    return df.withColumn("category", category).withColumn("portions", portions).filter("category is not null")


def lag_correlation(a: DataFrame, b: DataFrame, value: str, reach: int) -> DataFrame:
    """Correlation of ``a(x)`` with ``b(x + lag)`` for every lag up to ``reach``."""
    left = a.select("x", F.col(value).alias("va")).withColumn(
        "lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    )
    right = b.select(F.col("x").alias("xb"), F.col(value).alias("vb"))
    hit = left.join(right, F.col("xb") == F.col("x") + F.col("lag"))
    return hit.groupBy("lag").agg(F.count("*").alias("n"), safe_corr("va", "vb").alias("r"))


def align_windows(predictions: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Instant of each window: its middle row, ``x = window_idx + width // 2``."""
    width = F.lit(None).cast("int")
    for model, w in widths.items():
        width = F.when(F.col("model") == model, F.lit(w)).otherwise(width)
    return predictions.withColumn("x", (F.col("window_idx") + F.floor(width / 2)).cast("long"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: smallest id reachable over undirected ``(a, b)`` edges.

    Each round takes the smallest label among the neighbours and then jumps to the label's own label,
    so the rounds grow with the logarithm of the longest chain.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("low"))
        )
        step = labels.join(near, "id", "left").select("id", "component", F.least("component", "low").alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("further"))
        moved = cut_lineage(
            step.join(jump, "next", "left").select(
                "id", F.least("next", "further").alias("component"), F.col("component").alias("old")
            )
        )
        changed = moved.filter("component <> old").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
