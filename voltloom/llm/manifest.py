"""Merkle manifest of a table by nested intervals.

Rows become leaves in one pass; only ids and digests move on. Leaves are ordered by a range exchange over (group, id) and get their rank
from the counts of the parts, so one source may hold any share. A node carries the interval [low, high) of leaf ranks it covers. Levels are
cut into bands of ``BAND``: what lies under one node of a band's top (its bucket) meets in one bounded row, where every level of the band is
hashed. Going down, a bucket meets the node of the band above whose interval contains its own, and with it the siblings on its way to the
root. Inside a bucket ancestors are the nodes whose interval contains a leaf's rank, and the siblings of a node are the nodes in its parent's
interval that are not in its own. Digests are lowercase hex; a parent hashes its children's digests as text.

Defined results: nulls in any column are hashed as ``-``; a null group is its own and comes first; leaves without id come first in their
group, and rows that repeat an id are ordered by their digests and each keep their leaf; an empty table has no rows and no root; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.frame import arrow_schema
from voltloom.session import stage

FANOUT = 3
#: Levels whose nodes one row holds: 3**6 leaves at most.
BAND = 6
WIDTH = FANOUT**BAND

NODES = "key string, level int, low long, high long, digest string"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-``, or its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of documents with this text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def group_key(column: str = "source") -> Column:
    """Groups in byte order of their names, the null one first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``rank``, from 0, within ``key``; no group has to fit a task."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = stage(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(key, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(counts, [key, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def buckets(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each (key, bucket): ``low`` and ``digest`` (and more) of its nodes as arrays, ascending."""
    got = rows.groupBy("key", F.floor(F.col("place") / WIDTH).alias("bucket"))
    got = got.agg(F.sort_array(F.collect_list(F.struct("place", "digest", *more))).alias("m"))
    return got.select("key", "bucket", *[F.col(f"m.{c}").alias(c) for c in ("digest", *more)])


def hashed(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def rising(digests: list[str], lone: bool) -> list[list[str]]:
    """The levels over a bucket's nodes, first the nodes themselves; a bucket that is a whole tree ends at its root."""
    levels = [digests]
    for _ in range(BAND):
        if lone and len(levels[-1]) == 1:
            break
        below = levels[-1]
        levels.append([hashed(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return levels


def intervals(n: int, level: int, base: int, end: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf ranks that the n nodes of a level cover, from the rank of the first; none reaches beyond the last leaf."""
    low = base + FANOUT ** (first + level) * np.arange(n)
    return low, np.minimum(low + FANOUT ** (first + level), end)


def band(rows: DataFrame, sizes: DataFrame, number: int) -> DataFrame:
    """All nodes above ``rows`` (key, place, digest: the nodes of level ``BAND * number``) up to the next band's first level."""
    ready = buckets(rows).join(sizes, "key")
    schema = arrow_schema(NODES)
    first = BAND * number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                base = r["bucket"] * WIDTH * FANOUT**first
                levels = rising(r["digest"], r["leaves"] <= WIDTH * FANOUT**first)
                for k, digests in enumerate(levels):
                    low, high = intervals(len(digests), k, base, r["leaves"], first)
                    same = {"key": [r["key"]] * len(digests), "level": [first + k] * len(digests)}
                    yield pa.RecordBatch.from_pydict({**same, "low": low, "high": high, "digest": digests}, schema=schema)

    return ready.mapInArrow(run, NODES)


def tree(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``key, level, low, high, digest`` of all nodes over ``(key, place, digest)``, band by band, and ``key, leaves, digest`` of the roots.

    The last level of a band is the first of the next one and belongs to that.
    """
    sizes = stage(leaves.groupBy("key").agg(F.count("*").alias("leaves")))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    rows, bands = leaves.select("key", "place", "digest"), []
    while True:
        first = BAND * len(bands)
        nodes = stage(band(rows, sizes, len(bands)))
        bands.append(nodes)
        if most <= WIDTH * FANOUT**first:
            break
        top = nodes.filter(F.col("level") == first + BAND).join(sizes, "key").filter(F.col("leaves") > WIDTH * FANOUT**first)
        rows = top.select("key", F.floor(F.col("low") / FANOUT ** (first + BAND)).alias("place"), "digest")
    root = reduce(DataFrame.unionByName, bands).join(sizes, "key").filter("low = 0 and high = leaves")
    roots = root.groupBy("key").agg(F.max("leaves").alias("leaves"), F.max_by("digest", "level").alias("digest"))
    return bands, roots


def within(levels: list[tuple[np.ndarray, np.ndarray, list[str]]], low: np.ndarray) -> list[tuple[list[str], list[str]]]:
    """For nodes of the lowest level, by the first rank they cover: digests before and after on every level's run, up to the highest.

    An ancestor is the node of a level whose interval contains the rank. The nodes in its parent's interval, less its own, are its siblings.
    """
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in low]
    for (lows, _, digests), (up, up_end, _) in zip(levels, levels[1:]):
        own = np.searchsorted(lows, low, "right") - 1
        parent = np.searchsorted(up, low, "right") - 1
        a, b = np.searchsorted(lows, up[parent]), np.searchsorted(lows, up_end[parent])
        for k, (i, x, y) in enumerate(zip(own.tolist(), a.tolist(), b.tolist())):
            out[k][0].append("".join(digests[x:i]))
            out[k][1].append("".join(digests[i + 1 : y]))
    return out


def spread(nodes: DataFrame, span: int) -> DataFrame:
    """One row for each (key, bucket): the nodes of a band whose intervals lie in it, by level and rank."""
    got = nodes.groupBy("key", F.floor(F.col("low") / span).alias("bucket"))
    return got.agg(F.sort_array(F.collect_list(F.struct("level", "low", "high", "digest"))).alias("nodes"))


def nested(nodes: list[dict]) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Nodes in order of level and rank as (low, high, digest) for each level."""
    levels: dict[int, list[dict]] = {}
    for x in nodes:
        levels.setdefault(x["level"], []).append(x)
    return [(np.array([x["low"] for x in some]), np.array([x["high"] for x in some]), [x["digest"] for x in some]) for some in levels.values()]


def sides(row: dict) -> Iterator[tuple[list[str], list[str]]]:
    """For each lowest node of a bucket, in order, what stands before and after it on every level up to the root."""
    levels = nested(row["nodes"])
    return ((b + row["before"], a + row["after"]) for b, a in within(levels, levels[0][0]))


WAY = "key string, bucket long, before array<string>, after array<string>"


def ways(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """The way from the top of each lowest bucket to the root: what stands before and after it on every level.

    ``above`` (key, before, after) is the way of each group's root, for a tree that stands under another.
    """
    schema = arrow_schema(WAY)
    way = above.select("key", F.lit(0).cast("long").alias("bucket"), "before", "after")
    for number in range(len(bands) - 1, 0, -1):
        below = FANOUT ** (BAND * number)
        own = spread(bands[number], below * WIDTH)

        def run(batches, below=below):
            for batch in batches:
                for r in batch.to_pylist():
                    before, after = zip(*sides(r))
                    bucket = r["bucket"] * WIDTH + np.arange(len(before))
                    yield pa.RecordBatch.from_pydict({"key": [r["key"]] * len(before), "bucket": bucket, "before": before, "after": after}, schema=schema)

        lower = own.join(way, ["key", "bucket"]).mapInArrow(run, WAY)
        # groups that end in a lower band keep the way of their root
        way = stage(lower.unionByName(way.join(own.select("key").distinct(), "key", "left_anti")))
    return way


SIDES = "key string, before array<string>, after array<string>"


def sided(names: DataFrame, lowest: DataFrame, way: DataFrame) -> DataFrame:
    """The way of every subroot ``(key, place, digest, name)`` to the root; ``key`` is then its name."""
    met = buckets(names, "name").join(spread(lowest, WIDTH), ["key", "bucket"]).join(way, ["key", "bucket"])
    schema = arrow_schema(SIDES)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                before, after = zip(*sides(r))
                yield pa.RecordBatch.from_pydict({"key": r["name"], "before": before, "after": after}, schema=schema)

    return met.mapInArrow(run, SIDES)


PROVED = "key string, doc_id long, leaf string, proof_sha256 string, folded string"


def proved(leaves: DataFrame, lowest: DataFrame, way: DataFrame) -> DataFrame:
    """Of every leaf ``(key, place, digest, doc_id, changed)``: the digest of its siblings up to the root, and the root that ``changed`` gives."""
    met = buckets(leaves, "doc_id", "changed").join(spread(lowest, WIDTH), ["key", "bucket"]).join(way, ["key", "bucket"])
    schema = arrow_schema(PROVED)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                proof, folded = [], []
                for (before, after), changed in zip(sides(r), r["changed"], strict=True):
                    levels = list(zip(before, after, strict=True))
                    proof.append(hashed([x for side in levels for x in side]))
                    folded.append(reduce(lambda d, side: hashed([side[0], d, side[1]]), levels, changed))
                n = len(proof)
                yield pa.RecordBatch.from_pydict(
                    {"key": [r["key"]] * n, "doc_id": r["doc_id"], "leaf": r["digest"], "proof_sha256": proof, "folded": folded}, schema=schema
                )

    return met.mapInArrow(run, PROVED)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; ``tampered`` is the text that is to be proved."""
    leaves = docs.select(group_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), leaf(tampered).alias("changed"))
    leaves = stage(ranked(leaves, "key", ["doc_id", "digest"]).withColumnRenamed("rank", "place"))
    bands, subroots = tree(leaves)
    subroots = stage(subroots)
    names = ranked(subroots.select(F.lit("").alias("all"), F.col("key").alias("name"), "digest"), "all", ["name"])
    names = stage(names.select(F.col("all").alias("key"), F.col("rank").alias("place"), "digest", "name"))
    top, root = tree(names)
    root = stage(root)
    nothing = F.expr("cast(array() as array<string>)")
    above = stage(sided(names, top[0], ways(top, root.select("key", nothing.alias("before"), nothing.alias("after")))))
    found = proved(leaves, bands[0], ways(bands, above)).join(subroots.select("key", F.col("digest").alias("subroot")), "key")
    found = found.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def without_newlines() -> Column:
    """The text as a careless copy leaves it: where 2 divides the crc32 of the id, without its line ends."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
