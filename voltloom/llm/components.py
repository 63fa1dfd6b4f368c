"""Connected components of links between distinct keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id with an edge ``(a, b)``: root is the smallest id reachable.

    Two steps alternate on edges that point from the larger to the smaller id: each id sends its larger neighbours to its smallest one
    (large star), then its smaller neighbours and itself (small star). Each is an aggregate and a join on an id, so no neighbourhood is
    gathered into one row. The rounds end when nothing moves; they grow like the logarithm of the longest chain.
    """
    links, before = cut_lineage(directed(edges)), None
    while True:
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        links, before = cut_lineage(small_star(large_star(links))), now
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))


def directed(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def large_star(links: DataFrame) -> DataFrame:
    up = links.select(F.col("b").alias("v"), F.col("a").alias("n"))
    lowest = up.unionByName(links.select(F.col("a").alias("v"), F.col("b").alias("n"))).groupBy("v").agg(F.least("v", F.min("n")).alias("low"))
    return directed(up.join(lowest, "v").select(F.col("n").alias("a"), F.col("low").alias("b")))


def small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(lowest, "a")
    return directed(moved.select("b", "low").toDF("a", "b").unionByName(moved.select("a", "low").toDF("a", "b")))
