"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 where it is set in over half the XXH64 hashes (seed 42) of the text's word shingles. Equal
fingerprints become one class first, so copies cost one row. Two fingerprints that differ in at most three bits agree in three of six
blocks, so every class takes part under 20 keys of about 32 bits; what shares a key is compared bit by bit, and a key yields only the
links of a spanning forest, which loses no component. A key that more than ``CROWD`` classes share is dealt on: the bits it leaves free
are cut into eight parts of which five must agree, and under such a finer key at most 2**13 different fingerprints exist.

Defined results: a null or empty text has fingerprint zero and links like any other; a row without ``doc_id`` has no component; rows that
repeat a ``doc_id`` are one document with, possibly, several fingerprints; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.components import components
from voltloom.llm.frame import arrow_schema, mixed, per_batch, texts
from voltloom.session import stage

NEAR = 3
CROWD = 512
#: Classes under a block's value that meet pair by pair at once.
FEW = 8
#: Keys of larger crowds, the largest first, under which a class meets the one before it.
TURNS = 4
#: Classes of a larger crowd, and hashes of their shingles, that one row holds of each of two tiles.
TILE, TILE_HASHES = 2048, 1 << 20
#: Bits of the fingerprints that tell a share of similar shingles, and of a block of theirs.
WIDE, BLOCK = 1024, 20
STRETCH = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int64)


def spans(text: str, size: int) -> list[bytes]:
    """Word shingles as bytes, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    size = min(size, len(words))
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str, size: int) -> int:
    """As a signed number. ``bytes.lower`` and ``bytes.split`` know A-Z and the ASCII white space only."""
    shingles = spans(text, size)
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, 42) for x in shingles], "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": [fingerprint(t, size) for t in batch.column("text").to_pylist()]}

    return per_batch(texts(docs), "doc_id long, fp long", work)


def parts(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, n)]


def signed(bits: list[int]) -> int:
    value = sum(1 << int(b) for b in bits)
    return value - (1 << 64) if value >> 63 else value


def masks(bits: list[int], n: int, agree: int) -> list[tuple[int, list[int]]]:
    """Mask of each choice of ``agree`` out of n parts, with the bits it leaves free."""
    out = []
    for chosen in combinations(parts(bits, n), agree):
        held = [b for part in chosen for b in part]
        out.append((signed(held), [b for b in bits if b not in set(held)]))
    return out


def forest(ids: np.ndarray, prints: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs within ``near`` bits."""
    out, left, prints = [], np.arange(len(ids)), prints.view(np.uint64)  # of a negative number, the bits of its absolute would count
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(prints[left] ^ prints[at]) <= near
            hit = left[close]
            left = left[~close]
            out += [(int(ids[at]), int(ids[k])) for k in hit]
            queue += hit.tolist()
    return out


def links(classes: DataFrame, near: int = NEAR) -> DataFrame:
    """``(a, b)`` between ids of ``(id, fp)`` classes; their components are those of all pairs within ``near`` bits."""
    spark = classes.sparkSession
    coarse = masks(list(range(64)), near + 3, 3)
    keyed = classes.select(
        "id", "fp", F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, (m, _) in enumerate(coarse)])).alias("k")
    ).select("id", "fp", "k.choice", "k.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stage(keyed.join(shared, ["choice", "key"]))
    finer = spark.createDataFrame(
        [(c, s, m) for c, (_, free) in enumerate(coarse) for s, (m, _) in enumerate(masks(free, near + 5, 5))], "choice int, part int, mask long"
    )
    crowded = met.filter(F.col("n") > CROWD).join(finer, "choice")
    member = F.collect_set(F.struct("id", "fp")).alias("members")
    groups = met.filter(F.col("n") <= CROWD).groupBy("choice", "key").agg(member).select("members")
    crowds = crowded.groupBy("choice", "key", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("rest")).agg(member).select("members")
    both = groups.unionByName(crowds).filter(F.size("members") > 1)
    both = both.select(F.col("members.id").alias("ids"), F.col("members.fp").alias("fps"))
    schema = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                ids, fps = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "fps"))
                found += forest(ids, fps, near)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, near: int = NEAR) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest ``doc_id`` reachable over fingerprints that differ in at most ``near`` bits."""
    prints = stage(fingerprints(docs, size))
    known = prints.filter("doc_id is not null")
    classes = stage(known.groupBy("fp").agg(F.min("doc_id").alias("id")))
    same = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    repeated = known.join(same, "doc_id").join(classes, "fp").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = components(links(classes, near).unionByName(repeated))
    placed = classes.join(found, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(placed, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Hashes of the different shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in spans(text, size)), np.uint64))


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` fingerprint bits over the different shingles: each hash is stretched to as many bits."""
    ones = np.zeros((WIDE // 8, 8))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            long = mixed(hashes[k : k + 2048, None] + STRETCH).view(np.uint8).astype(np.int64)
            counts = np.bincount((long + 256 * np.arange(WIDE // 8)).ravel(), minlength=32 * WIDE).reshape(WIDE // 8, 256)
            ones += counts.astype(float) @ BITS.astype(float)
    return (2 * ones > len(hashes)).ravel()


def differing(bits: int, similarity: float, deviations: float) -> int:
    """Bits of so many in which sets of that Jaccard similarity are expected to differ, and standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def close_rows(at: np.ndarray, tiles: np.ndarray, prints: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 128 rows at a time, the first and which later rows are within ``limit`` bits of each and in another component.

    Where there are two tiles, pairs within one are left to the row of that tile alone. What the last row's component holds at the end has no
    later rows in others.
    """
    n, two, others = len(at), tiles.min() < tiles.max(), np.flatnonzero(at != at[-1])
    last = int(others[-1]) + 1 if len(others) else 0
    for first in range(0, last, 128):
        some = np.arange(first, min(first + 128, last))
        apart = np.zeros((len(some), n), np.int16)
        for k in range(prints.shape[1]):
            apart += np.bitwise_count(prints[some, k, None] ^ prints[None, :, k])
        good = (apart <= limit) & (at[some, None] != at) & (np.arange(n) > some[:, None])
        if two:
            good &= tiles[some, None] != tiles
        yield first, good


def largest_last(roots: np.ndarray) -> np.ndarray:
    """Places in an order that has the largest component at the end."""
    _, at, counts = np.unique(roots, return_inverse=True, return_counts=True)
    return np.argsort(at == counts.argmax(), kind="stable")


def bridges(roots: np.ndarray, tiles: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], limit: int, similarity: float) -> list[tuple[int, int]]:
    """Places of pairs that join all components between which there is a pair within ``limit`` bits with sets of that similarity.

    Two that are joined are not compared again, so there are fewer pairs than components.
    """
    out, order = [], largest_last(roots)
    at, size = roots[order], np.array([len(sets[k]) for k in order])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(x) for x in sets])
    own = [codes[ends[k] - len(sets[k]) : ends[k]] for k in order]
    marked = np.zeros(len(codes), bool)
    joined = at.copy()
    for first, good in close_rows(at, tiles[order], prints[order], limit):
        for i in np.flatnonzero(good.any(axis=1)):
            x = first + i
            marked[own[x]] = True
            for y in np.flatnonzero(good[i]):
                if joined[x] != joined[y]:
                    same = np.count_nonzero(marked[own[y]])
                    if same >= similarity * (size[x] + size[y] - same):
                        out.append((int(order[x]), int(order[y])))
                        joined[joined == joined[y]] = joined[x]
            marked[own[x]] = False
    return out


def rooted(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """``crowd`` (id, size, block, key) with each class's component: its many rows and the one of its root meet under the id, once."""
    marks = found.select("id", F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("key"), "root")
    both = crowd.withColumn("root", F.lit(None).cast("long")).unionByName(marks)
    return both.withColumn("root", F.coalesce(F.max("root").over(Window.partitionBy("id")), "id")).filter("block is not null")


def led(members: DataFrame) -> DataFrame:
    """``members`` under keys of several components, with ``main``: the component that more than half of a key's classes belong to, or NULL."""
    key, own = Window.partitionBy("block", "key"), Window.partitionBy("block", "key", "root")
    out = members.withColumn("same", F.count("*").over(own)).withColumns({
        "n": F.count("*").over(key), "low": F.min("root").over(key), "high": F.max("root").over(key), "most": F.max(F.struct("same", "root")).over(key),
    })
    return out.filter("low <> high").select("id", "size", "root", "block", "key", F.when(2 * F.col("most.same") > F.col("n"), F.col("most.root")).alias("main"))


def tiles_of(name: str):
    """Tiles of about ``TILE`` classes, and of no more than about ``TILE_HASHES`` hashes of shingles."""
    return F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_HASHES, F.lit(1.0))).cast("int").alias(name)


def crowd_pairs(members: DataFrame) -> DataFrame:
    """``block, key, t, u, id, root, tile``: who meets whom of ``(id, size, root, block, key)``.

    A key of one component has no rows. A larger one is cut into tiles, and every two of them meet.
    """
    several = members.groupBy("block", "key").agg(tiles_of("tiles"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    tiled = members.join(several, ["block", "key"]).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return tiled.select("block", F.col("key").cast("long").alias("key"), F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "id", "root", "tile").distinct()


def main_pairs(asked: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """As ``crowd_pairs``, for classes ``(id, size, root, main)`` and those of component ``main``, which ``key`` names.

    However many keys two classes share, they meet once: a component is cut into tiles, and so are those that ask.
    """
    asks = asked.distinct()
    own = found.withColumn("main", F.col("root")).join(asks.select("main").distinct(), "main", "left_semi").join(sizes, "id")
    counts = own.groupBy("main").agg(tiles_of("tiles")).join(asks.groupBy("main").agg(tiles_of("heaps")), "main")
    place = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    row = (F.lit(-1).alias("block"), F.col("main").alias("key"))
    own = own.join(counts, "main").select(*row, place("tiles").alias("t"), every("heaps").alias("u"), "id", "root", F.lit(0).alias("tile"))
    asks = asks.join(counts, "main").select(*row, every("tiles").alias("t"), place("heaps").alias("u"), "id", "root", F.lit(1).alias("tile"))
    return own.unionByName(asks).distinct()


def gathered(met: DataFrame, *columns: str) -> DataFrame:
    """A row for those that meet, with arrays; ``wide`` in one array."""
    both = met.groupBy("block", "key", "t", "u").agg(F.collect_list(F.struct("id", "root", "tile", "wide", *columns)).alias("m"))
    return both.select("block", "key", "t", "u", *[F.col(f"m.{c}").alias(c) for c in ("id", "root", "tile", *columns)], F.flatten("m.wide").alias("wide"))


def shingled(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id, shingles``: the set of each different text of these ids."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("doc_id"), "shingles": [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()]}

    known = texts(docs).join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return per_batch(known, "id long, shingles binary", work).distinct()


def bridged(met: DataFrame, wide: DataFrame, docs: DataFrame, size: int, limit: int, similarity: float) -> DataFrame:
    """``(a, b)``: links that join all components of which two classes that meet are similar.

    The pairs stay inside the tasks. Fingerprints first say who of a meeting has a candidate at all; only these meet again with their shingles.
    """
    ddl = "block int, key long, t int, u int, id long, root long, tile int"
    schema, link = arrow_schema(ddl), arrow_schema("a long, b long")

    def read(batch, k):
        ids, roots, tiles, prints = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("id", "root", "tile", "wide"))
        return ids, roots, tiles, prints.view(np.uint64).reshape(len(ids), -1)

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, roots, tiles, prints = read(batch, k)
                order = largest_last(roots)
                hit = np.zeros(len(ids), bool)
                for first, good in close_rows(roots[order], tiles[order], prints[order], limit):
                    hit[first : first + len(good)] |= good.any(axis=1)
                    hit |= good.any(axis=0)
                at = order[hit]
                at = at[np.unique(ids[at], return_index=True)[1]]
                same = {c: [batch.column(c)[k].as_py()] * len(at) for c in ("block", "key", "t", "u")}
                yield pa.RecordBatch.from_pydict({**same, "id": ids[at], "root": roots[at], "tile": tiles[at]}, schema=schema)

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, roots, tiles, prints = read(batch, k)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")[k].values]
                a, b = np.array(bridges(roots, tiles, prints, sets, limit, similarity), np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b]}, schema=link)

    asked = stage(gathered(met.join(wide, "id")).mapInArrow(ask, ddl))
    again = asked.join(shingled(docs, asked, size), "id").join(wide, "id")
    return gathered(again, "shingles").mapInArrow(compare, "a long, b long")


def alike(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of the different pairs ``(a, b)`` of ids, those whose texts have shingle sets of that Jaccard similarity or more."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    known = texts(docs).join(asked, "doc_id", "left_semi").distinct()
    both = pairs.join(known.toDF("a", "text_a"), "a").join(known.toDF("b", "text_b"), "b")
    schema = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            seen: dict = {}
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].as_py() for c in ("text_a", "text_b"))
                for t in (x, y):
                    if t not in seen:
                        seen[t] = shingle_set(t, size)
                x, y = seen[x], seen[y]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = same >= similarity * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], schema=schema)

    return both.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``doc_id, component_id`` over documents whose word shingles are similar, which differ in many more bits than ``NEAR``.

    Fingerprints have ``WIDE`` bits. A block is ``BLOCK`` sampled bits; there are so many blocks that a pair at the threshold shares one with
    the wished recall. Fingerprints only propose: a pair within three standard deviations becomes a link if the shingle sets themselves are
    similar. All classes under a block's value meet. Up to ``FEW`` do so pair by pair on their first 64 bits. Of larger crowds, a class first
    meets the one before it in the order of these bits, in ``TURNS`` of its crowds. Then all that other components still hold meet in tiles;
    there pairs are compared inside the tasks, and only links between components that are still apart come out, so that a crowd never
    becomes rows of pairs. What belongs to a component that holds most of a crowd meets the rest of all such crowds once, however many keys
    they share.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** BLOCK))
    places = np.random.default_rng(11).permuted(np.tile(np.arange(WIDE), (n, 1)), axis=1)[:, :BLOCK]
    limit, first_limit = differing(WIDE, similarity, 3), differing(64, similarity, 4)

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
        bits = np.stack([wide_bits(x) for x in sets])
        keys = bits[:, places] @ (1 << np.arange(BLOCK))
        words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        return {"doc_id": batch.column("doc_id"), "same": same, "size": [len(x) for x in sets], "wide": list(words), "keys": list(keys)}

    prints = stage(per_batch(texts(docs).filter("doc_id is not null"), "doc_id long, same binary, size int, wide array<long>, keys array<int>", work))
    classes = stage(prints.groupBy("same").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("size", "wide", "keys")]))
    wide = classes.select("id", "wide")
    keyed = classes.select("id", "size", F.col("wide")[0].alias("lead"), F.posexplode("keys").alias("block", "key"))
    group = Window.partitionBy("block", "key")
    beside = keyed.select(
        "id", "size", "lead", "block", "key", F.count("*").over(group).alias("n"),
        F.collect_list(F.struct("id", "lead")).over(group.orderBy("lead", "id").rowsBetween(1 - FEW, -1)).alias("before"),
    ).filter("n > 1")
    beside = beside.withColumn("before", F.when(F.col("n") > FEW, F.slice("before", F.greatest(F.size("before"), F.lit(1)), 1)).otherwise(F.col("before")))
    beside = beside.withColumn("before", F.filter("before", lambda x: F.bit_count(x["lead"].bitwiseXOR(F.col("lead"))) <= first_limit)["id"])
    met = stage(beside.drop("lead").filter((F.col("n") > FEW) | (F.size("before") > 0)))
    crowd = met.filter(F.col("n") > FEW)
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "block"))
    some = met.filter(F.col("n") <= FEW).select("id", "before").union(crowd.withColumn("turn", turn).filter(F.col("turn") <= TURNS).select("id", "before"))
    pairs = some.select("id", F.explode("before").alias("other")).filter("id <> other")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    both = pairs.join(wide.toDF("a", "wide_a"), "a").join(wide.toDF("b", "wide_b"), "b")
    apart = sum((F.bit_count(F.col("wide_a")[k].bitwiseXOR(F.col("wide_b")[k])) for k in range(WIDE // 64)), F.lit(0))
    tried = stage(both.filter(apart <= limit).select("a", "b").distinct())
    copies = prints.join(classes.select("same", "id"), "same").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    linked = stage(alike(tried, docs, size, similarity).unionByName(copies))
    found = components(linked)
    members = stage(led(rooted(crowd.select("id", "size", "block", "key"), found)))
    besides = members.filter("main is null or root <> main")  # a main component meets the others once, not under each key
    asked = besides.filter("main is not null").select("id", "size", "root", "main")
    meetings = crowd_pairs(besides.drop("main")).unionByName(main_pairs(asked, found, classes.select("id", "size")))
    found = components(linked.unionByName(bridged(meetings, wide, docs, size, limit, similarity)))
    ids = prints.select("doc_id").distinct()
    return ids.join(found, ids.doc_id == found.id, "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, whole, without those whose component has a smaller ``doc_id``."""
    copies = similar(docs, size, similarity).filter("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
