"""Hard negatives by a multiway hyperplane tree with ranges.

Every inner node has up to ``FAN`` split points, and a row goes down to the nearest; the tree is fitted on at most ``SAMPLE`` rows and all
rows are placed in it. A node stores, for each split point and each sibling subtree, the least and greatest distance (the origin counts as
one more split point, so norms need not agree). A query asks for rows whose score lies in windows; with the norms of a subtree a window is
an annulus around the query, and the subtree is left out if for some split point no distance of its range can lie in it. What remains is
scored exactly, in integers, leaf by leaf.

A search runs in two steps: the leaf of the anchor itself gives a bound, which narrows the windows for all other leaves. Leaves are cut
into chunks of about ``CHUNK`` rows and anchors into blocks, so one leaf may hold any share of the rows; a pair of both is one task's unit,
and a task keeps only the best so far of each anchor.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part, nor do those with a component that
a long cannot hold; of rows that repeat an id the one with the least (label, vector) counts; a shorter vector is continued with zeros; ties
go to the smaller id; a score beyond a long raises, as in SQL; extra columns are left out; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.frame import arrow_schema
from voltloom.session import stage

FAN = 8
#: Rows the tree is fitted on, and those of them that a leaf holds at least on average.
SAMPLE, FEW = 8192, 16
CHUNK = 4096
#: Blocks of anchors whose best rows a task holds.
HELD = 64
#: Room for the rounding of distances; it only keeps a subtree more.
SLACK = 1e-6
LIMIT = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Split points of each inner node and its children: the number of an inner node, or of a leaf as ``-1 - leaf``."""

    width: int
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def grow(self, rows: np.ndarray, least: int) -> int:
        points = spread_out(rows) if len(rows) > least else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        at = distances(rows, points).argmin(axis=1)
        self.children[node] = [self.grow(rows[at == j], least) for j in range(len(points))]
        return node


def spread_out(rows: np.ndarray) -> np.ndarray:
    """Different rows far from each other: each is the farthest of a few candidates from those before it."""
    some = rows[:: max(1, len(rows) // (8 * FAN))]
    chosen = [0]
    apart = distances(some, some[:1])[:, 0]
    while len(chosen) < FAN and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * rows @ points.T
    return np.sqrt(np.maximum(square, 0))


def fit(rows: DataFrame) -> Tree:
    """The tree over ``(vec_id, vec)``, without ranges; the sample is chosen by the hash of the ids."""
    sample = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    tree = Tree(width)
    tree.grow(matrix(sample.column("vec").combine_chunks(), width), FEW * FAN)
    return tree


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, continued with zeros."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == width * len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def descend(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Leaf of each row, and for each node met its rows' distances to the split points and the child they go to."""
    leaf, met = np.zeros(len(rows), np.int64), []
    queue = [(0 if tree.points else -1, np.arange(len(rows)))]
    while queue:
        node, own = queue.pop()
        if node < 0:
            leaf[own] = -1 - node
        elif len(own):
            apart = distances(rows[own], tree.points[node])
            at = apart.argmin(axis=1)
            met.append((node, np.column_stack([apart, np.sqrt((rows[own] ** 2).sum(axis=1))]), at))
            queue += [(child, own[at == j]) for j, child in enumerate(tree.children[node])]
    return leaf, met


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    ddl = "vec_id long, label long, vec array<long>, leaf int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = descend(tree, matrix(batch.column("vec"), tree.width))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vec")), pa.array(leaf.astype(np.int32))], schema=schema)

    return rows.mapInArrow(run, ddl)


def with_ranges(tree: Tree, rows: DataFrame) -> Tree:
    """The tree with the ranges over all rows: least and greatest per task, then over tasks; a few hundred numbers a node."""
    ddl = "node int, child int, point int, low double, high double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for node, apart, at in descend(tree, matrix(batch.column("vec"), tree.width))[1]:
                for j in np.unique(at).tolist():
                    own = apart[at == j]
                    low, high = found.get((node, j), (np.inf, -np.inf))
                    found[node, j] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        flat = [(n, j, i, lo, hi) for (n, j), (low, high) in found.items() for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist()))]
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*flat) if flat else [()] * 5)), schema=schema)

    got = rows.select("vec").mapInArrow(run, ddl).groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in got.collect():
        size = len(tree.points[r.node]) + 1
        low, high = tree.ranges.setdefault((r.node, r.child), (np.zeros(size), np.zeros(size)))
        low[r.point], high[r.point] = r.low, r.high
    return tree


def visited(tree: Tree, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
    """For each leaf the queries some score window (query, window) of theirs may find rows in; an empty window is NaN."""
    out: dict[int, np.ndarray] = {}
    square = (rows**2).sum(axis=1)
    queue = [(0 if tree.points else -1, np.arange(len(rows)), ~np.isnan(low))]
    while queue:
        node, own, open_ = queue.pop()
        if node < 0:
            out[-1 - node] = own
            continue
        apart = np.column_stack([distances(rows[own], tree.points[node]), np.sqrt(square[own])])
        for j, child in enumerate(tree.children[node]):
            if (node, j) not in tree.ranges:
                continue  # no row went there
            least, most = tree.ranges[node, j]
            r1 = np.sqrt(np.maximum(square[own, None] + least[-1] ** 2 - 2 * high[own], 0))[:, :, None]
            r2 = np.sqrt(np.maximum(square[own, None] + most[-1] ** 2 - 2 * low[own], 0))[:, :, None]
            none = square[own, None] + most[-1] ** 2 - 2 * low[own] < -SLACK * square[own, None]
            d = apart[:, None, :]
            room = SLACK * (1 + d + most)
            meets = (np.maximum(r1 - d, d - r2) <= most + room) & (d + r2 >= least - room)
            left = open_ & ~none & meets.all(axis=2)
            some = left.any(axis=1)
            if some.any():
                queue.append((child, own[some], left[some]))
    return out


BLOCK = "leaf int, block long, ids array<long>, labels array<long>, vecs array<long>, lows array<double>, highs array<double>"


def blocks(anchors: DataFrame, tree: Tree, windows: int, home: bool) -> DataFrame:
    """Anchors ``(vec_id, label, vec, leaf, lows, highs)`` that visit a leaf, a batch in a row: their own leaf only, or all but that."""
    schema = arrow_schema(BLOCK.replace("array<double>", "array<long>")).set(5, pa.field("lows", pa.list_(pa.float64()))).set(6, pa.field("highs", pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vec"), tree.width)
            low, high = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), windows) for c in ("lows", "highs"))
            own = batch.column("leaf").to_numpy()
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            if home:
                asked = {int(k): np.flatnonzero(own == k) for k in np.unique(own)}
            else:
                asked = {k: some[own[some] != k] for k, some in visited(tree, rows, low, high).items()}
            for leaf, some in asked.items():
                if len(some):
                    values = [[leaf], [block], [ids[some]], [labels[some]], [rows[some].astype(np.int64).ravel()], [low[some].ravel()], [high[some].ravel()]]
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, values)), schema=schema)
            block += 1

    return anchors.select("vec_id", "label", "vec", "leaf", "lows", "highs").mapInArrow(run, BLOCK)


def chunked(rows: DataFrame) -> DataFrame:
    """The rows of each leaf in chunks: ``leaf, salt, salts, c_ids, c_labels, c_vecs``."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))  # a row a leaf, at most SAMPLE
    salted = rows.join(F.broadcast(sizes), "leaf").withColumn("salt", F.expr("cast(pmod(xxhash64(vec_id), salts) as int)"))
    got = salted.groupBy("leaf", "salt", "salts").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "vec"))).alias("m"))
    return got.select("leaf", "salt", "salts", F.col("m.vec_id").alias("c_ids"), F.col("m.label").alias("c_labels"), F.col("m.vec").alias("c_vecs"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    if most >= LIMIT:
        raise OverflowError("a score does not fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


FOUND = "anchor_id long, window int, id long, score long"


def search(anchors: DataFrame, chunks: DataFrame, tree: Tree, windows: int, best: int, same: bool, home: bool) -> DataFrame:
    """``anchor_id, window, id, score``: the best of each anchor's windows over the leaves it visits, several times if several tasks found some."""
    salts = chunks.select("leaf", "salt", "salts")
    asked = blocks(anchors, tree, windows, home).join(F.broadcast(salts.groupBy("leaf").agg(F.max("salts").alias("salts"))), "leaf")
    asked = asked.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    met = asked.join(chunks.drop("salts"), ["leaf", "salt"])
    schema = arrow_schema(FOUND)
    width = tree.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, w, i, s = rows.T
            return pa.RecordBatch.from_pydict({"anchor_id": a, "window": w.astype(np.int32), "id": i, "score": s}, schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                get = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("leaf", "salt", "block", "c_vecs")}
                vecs = get["vecs"].reshape(len(get["ids"]), width).astype(float)
                rows = matrix(batch.column("c_vecs")[k].values, width)
                low, high = (get[c].reshape(len(vecs), windows) for c in ("lows", "highs"))
                block = batch.column("block")[k].as_py()
                for some in np.array_split(np.arange(len(vecs)), -(-len(vecs) // 128)):
                    s = scores(vecs[some], rows)
                    good = (get["labels"][some, None] == get["c_labels"]) == same
                    good &= get["ids"][some, None] != get["c_ids"]
                    parts = [held.pop((block, int(some[0])), np.zeros((0, 4), np.int64))]
                    for w in range(windows):
                        i, j = np.nonzero(good & (s >= low[some, w, None]) & (s <= high[some, w, None]))
                        parts.append(np.column_stack([get["ids"][some][i], np.full(len(i), w), get["c_ids"][j], s[i, j].astype(np.int64)]))
                    held[block, int(some[0])] = top(np.concatenate(parts), best)
            while len(held) > HELD:
                yield out(held.pop(next(iter(held))))
        for rows in held.values():
            yield out(rows)

    return met.mapInArrow(run, FOUND)


def top(rows: np.ndarray, best: int) -> np.ndarray:
    """Of (anchor, window, id, score) the first few of each anchor and window, higher scores first, ties by smaller id."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    starts = np.flatnonzero(fresh)
    return rows[np.arange(len(rows)) - starts[np.cumsum(fresh) - 1] < best] if len(rows) else rows


def firsts(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def nearest(anchors: DataFrame, chunks: DataFrame, tree: Tree, windows: int, best: int, same: bool) -> DataFrame:
    """The best rows in every window of every anchor ``(vec_id, label, vec, leaf, lows, highs)``."""
    near = stage(firsts(search(anchors, chunks, tree, windows, best, same, True), best))
    bound = near.filter(F.col("rank") == best).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bound"))
    tight = F.transform("lows", lambda x, k: F.greatest(x, F.try_element_at("bound", k.cast("int")).cast("double")))
    rest = anchors.join(bound, "vec_id", "left").withColumn("lows", F.when(F.col("bound").isNull(), F.col("lows")).otherwise(tight)).drop("bound")
    far = search(rest.repartitionByRange("leaf", "vec_id"), chunks, tree, windows, best, same, False)
    return firsts(near.select("anchor_id", "window", "id", "score").unionByName(far), best)


def known(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part, components scaled to integers."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("vec")).dropna()
    whole = whole.filter(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float(2**62), F.lit(False))))
    whole = whole.withColumn("vec", F.transform("vec", lambda x: F.floor(x).cast("long")))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("m")).select("vec_id", "m.label", "m.vec")


def mined(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``(vec_id, label, vec)``.

    Anchors are the rows whose id is divisible by ``every``. A negative's score is ``low`` to ``high`` per cent of the positive's.
    """
    rows = stage(rows)
    tree = fit(rows)
    rows = stage(placed(rows, tree))
    tree = with_ranges(tree, rows)
    chunks = stage(chunked(rows))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    inf = F.lit(float("inf"))
    like = anchors.withColumn("lows", F.array(-inf)).withColumn("highs", F.array(inf))
    pairs = stage(nearest(like, chunks, tree, 1, positives, True).select("anchor_id", F.col("rank").alias("k"), "id", "score"))
    own = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "score"))).alias("s"))
    nan = F.lit(float("nan"))
    score = [F.try_element_at("s", F.lit(k + 1)) for k in range(positives)]
    lows = F.array(*[F.coalesce(F.ceil(s * low / 100).cast("double"), nan) for s in score])
    highs = F.array(*[F.coalesce(F.floor(s * high / 100).cast("double"), nan) for s in score])
    unlike = anchors.join(own, "vec_id").withColumn("lows", lows).withColumn("highs", highs).drop("s")
    found = nearest(unlike, chunks, tree, positives, negatives, False)
    found = found.select("anchor_id", (F.col("window") + 1).alias("k"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = pairs.select("anchor_id", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(found, ["anchor_id", "k"])
    exact = (F.col("positive_score") * low <= F.col("negative_score") * 100) & (F.col("negative_score") * 100 <= F.col("positive_score") * high)
    return both.filter(exact).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
