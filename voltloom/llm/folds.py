"""Rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.llm.frame import texts


def held_out(name: str = "doc_id") -> Column:
    """One row in five, by the crc32 of the id as text; null ids are never held out and never learnt from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled rows outside the held-out fold, chosen by the hash of their ids.

    Two labels of one id count as the smaller. The chosen ids are broadcast, which the bound allows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    own = own.filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def unlabelled(docs: DataFrame, bound: int) -> DataFrame:
    """``doc_id, text`` of at most ``bound`` rows outside the held-out fold, chosen by the hash of their ids."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().filter(~held_out()).distinct()
    chosen = own.orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(bound)
    return texts(docs).join(F.broadcast(chosen), "doc_id")
