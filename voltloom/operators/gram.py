"""All members of a group against each other, from products of time-blocked matrices.

Rows ``(meter_id, variable, x, value)`` become one matrix per (variable, time block, tile of meters), with a mask of what is known. Two tiles
of a block meet in one row; sums over their common steps are matrix products, added over the blocks. So a pair costs a few numbers a block and
never its steps, a group of any size is cut into tiles of about ``TILE`` meters, and there is no list of pairs to begin with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.session import stage

TILE = 64
#: Classes of a channel's magnitudes; only the values of the classes round the median of a pair leave their block.
CLASSES = 32

SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def tiled(rows: DataFrame, block: int, meters: int) -> DataFrame:
    """One row for each (variable, block, tile): the known cells of its meters, off each channel's least value.

    A tile that knows nothing in a block still has its row there, without cells.
    """
    low = rows.groupBy("meter_id", "variable").agg(F.min("value").alias("low"), F.percentile_approx(F.abs("value"), [k / CLASSES for k in range(1, CLASSES)], 2000).alias("edges"))
    cells = rows.join(low, ["meter_id", "variable"])
    cells = cells.withColumn("class", F.size(F.filter("edges", lambda e: e < F.abs("value"))))
    tile = F.pmod(F.xxhash64("meter_id"), F.lit(-(-meters // TILE))).cast("int")
    cell = F.struct("meter_id", (F.col("x") % block).cast("int").alias("at"), F.col("value"), (F.col("value") - F.col("low")).alias("off"), "class")
    got = cells.groupBy("variable", F.floor(F.col("x") / block).alias("blk"), tile.alias("tile")).agg(F.collect_list(F.when(F.col("value").isNotNull(), cell)).alias("c"))
    return got.select("variable", "blk", "tile", *[F.col(f"c.{c}").alias(c) for c in ("meter_id", "at", "value", "off", "class")])


class Tile:
    """The matrices of a tile in one block: meters by steps, NaN where nothing is known."""

    def __init__(self, row: dict, side: str, block: int):
        get = {c: row[f"{side}_{c}"] for c in ("meter_id", "at", "value", "off", "class")}
        self.ids, at = np.unique(get["meter_id"], return_inverse=True)
        self.mask = np.zeros((len(self.ids), block))
        self.mask[at, get["at"]] = 1
        self.off, self.raw, self.kind = np.zeros_like(self.mask), np.zeros_like(self.mask), np.full(self.mask.shape, -1)
        self.off[at, get["at"]], self.raw[at, get["at"]], self.kind[at, get["at"]] = get["off"], get["value"], get["class"]


def meet(tiles: DataFrame, ddl: str, schema: pa.Schema, work: Callable[[dict, Tile, Tile], dict | None], block: int, more: DataFrame | None = None, both: bool = False) -> DataFrame:
    """``work`` for every two tiles of a block (a tile and itself, too); ``both`` also lets them meet the other way round.

    ``more`` has a row for each (variable, a_tile, b_tile), for which alone tiles then meet.
    """
    side = lambda s: tiles.select("variable", "blk", *[F.col(c).alias(f"{s}_{c}") for c in ("tile", "meter_id", "at", "value", "off", "class")])
    met = side("a").join(side("b"), ["variable", "blk"])
    if not both:
        met = met.filter("a_tile <= b_tile")
    if more is not None:
        met = met.join(more, ["variable", "a_tile", "b_tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: as_values(batch.column(c)[k]) for c in batch.schema.names}
                found = work(row, Tile(row, "a", block), Tile(row, "b", block))
                if found:
                    n = len(next(iter(found.values())))
                    yield pa.RecordBatch.from_pydict({"variable": [row["variable"]] * n, **found}, schema=schema)

    return met.mapInArrow(run, ddl)


def as_values(cell: pa.Scalar):
    flat = isinstance(cell, pa.ListScalar) and not pa.types.is_struct(cell.type.value_type)
    return cell.values.to_numpy(zero_copy_only=False) if flat else cell.as_py()


def pairs_of(a: Tile, b: Tile, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with a common step, each pair of meters once."""
    same = len(a.ids) and len(b.ids) and a.ids[0] == b.ids[0]  # tiles share no meter unless they are one
    return np.nonzero((n > 0) & (a.ids[:, None] < b.ids if same else True))


PRODUCTS = "variable string, a long, b long, " + ", ".join(f"{c} double" for c in SUMS) + ", ca array<double>, cb array<double>"
PRODUCTS_ARROW = pa.schema([("variable", pa.string()), ("a", pa.int64()), ("b", pa.int64()), *[(c, pa.float64()) for c in SUMS],
                            ("ca", pa.list_(pa.float64())), ("cb", pa.list_(pa.float64()))])


def products(tiles: DataFrame, block: int, classes: bool = False) -> DataFrame:
    """``variable, a, b`` (a < b) of all pairs with common steps: sums over them, of values off their channel's least.

    With ``classes`` also the counts of either side's magnitudes by class, ``ca`` and ``cb``.
    """

    def work(row: dict, a: Tile, b: Tile) -> dict | None:
        n = a.mask @ b.mask.T
        i, j = pairs_of(a, b, n)
        if not len(i):
            return None
        sums = [n, a.off @ b.mask.T, a.mask @ b.off.T, (a.off**2) @ b.mask.T, a.mask @ (b.off**2).T, a.off @ b.off.T]
        swap = a.ids[i] > b.ids[j]
        lower, upper = np.where(swap, b.ids[j], a.ids[i]), np.where(swap, a.ids[i], b.ids[j])
        v = {c: s[i, j] for c, s in zip(SUMS, sums, strict=True)}
        for x, y in (("sa", "sb"), ("saa", "sbb")):
            v[x], v[y] = np.where(swap, v[y], v[x]), np.where(swap, v[x], v[y])
        ca = cb = np.zeros((len(i), 0))
        if classes:
            ca = np.stack([((a.kind == k) @ b.mask.T)[i, j] for k in range(CLASSES)], axis=1)
            cb = np.stack([(a.mask @ (b.kind == k).T)[i, j] for k in range(CLASSES)], axis=1)
            ca, cb = np.where(swap[:, None], cb, ca), np.where(swap[:, None], ca, cb)
        return {"a": lower, "b": upper, **v, "ca": list(ca), "cb": list(cb)}

    met = meet(tiles, PRODUCTS, PRODUCTS_ARROW, work, block)
    counts = [F.array(*[F.sum(F.col(c)[k]) for k in range(CLASSES)]).alias(c) for c in ("ca", "cb")] if classes else []
    return met.groupBy("variable", "a", "b").agg(*[F.sum(c).alias(c) for c in SUMS], *counts)


def fitted(sums: DataFrame) -> DataFrame:
    """The sums with spreads ``sd_a, sd_b``, the correlation ``r`` (NULL without spread) and the covariance."""
    n = F.col("n")
    var = lambda c: F.greatest(F.col(f"s{c}{c}") / n - (F.col(f"s{c}") / n) * (F.col(f"s{c}") / n), F.lit(0.0))
    out = sums.withColumns({"sd_a": F.sqrt(var("a")), "sd_b": F.sqrt(var("b")), "cov": F.col("sab") / n - (F.col("sa") / n) * (F.col("sb") / n)})
    spread = (F.col("sd_a") > 1e-12) & (F.col("sd_b") > 1e-12)
    return out.withColumn("r", F.when(spread, F.col("cov") / (F.col("sd_a") * F.col("sd_b"))))


def medians(tiles: DataFrame, sums: DataFrame, block: int, meters: int) -> DataFrame:
    """``variable, a, b, ma, mb``: exact medians of the magnitudes of both meters over their common steps.

    The class counts place the two middle ranks; of a pair only the values of those classes leave the blocks.
    """
    half = [F.floor((F.col("n") - 1) / 2).alias("r0"), F.floor(F.col("n") / 2).alias("r1")]
    sides = sums.select("variable", "a", "b", *half, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ca").alias("c")), F.struct(F.lit(1).alias("side"), F.col("cb").alias("c")))).alias("s"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(CLASSES)), lambda k: F.aggregate(F.slice("s.c", 1, k), F.lit(0.0), lambda x, y: x + y))
    sides = sides.withColumn("upto", upto).select("variable", "a", "b", "r0", "r1", "s.side", "upto")
    at = lambda r: F.size(F.filter("upto", lambda u: u <= F.col(r)))
    sides = sides.withColumn("k0", at("r0")).withColumn("k1", at("r1"))
    before = F.when(F.col("k0") > 0, F.element_at("upto", F.greatest("k0", F.lit(1)))).otherwise(F.lit(0.0))
    sides = stage(sides.withColumn("before", before).drop("upto"))
    tile = lambda c: F.pmod(F.xxhash64(F.col(c).cast("int")), F.lit(-(-meters // TILE))).cast("int")
    # the values asked for are those of the meter ``own`` where ``other`` is known
    own = sides.withColumn("own", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))).withColumn("other", F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")))
    wanted = own.groupBy("variable", tile("own").alias("a_tile"), tile("other").alias("b_tile")).agg(F.collect_list(F.struct("own", "other", "k0", "k1")).alias("wanted"))
    schema = pa.schema([("variable", pa.string()), ("own", pa.int64()), ("other", pa.int64()), ("values", pa.list_(pa.float64()))])

    def work(row: dict, a: Tile, b: Tile) -> dict | None:
        place = [{int(m): k for k, m in enumerate(t.ids)} for t in (a, b)]
        out: dict[str, list] = {"own": [], "other": [], "values": []}
        for w in row["wanted"]:
            i, j = place[0].get(w["own"]), place[1].get(w["other"])
            if i is not None and j is not None:
                hit = (a.kind[i] >= w["k0"]) & (a.kind[i] <= w["k1"]) & (b.mask[j] > 0)
                if hit.any():
                    out["own"].append(w["own"])
                    out["other"].append(w["other"])
                    out["values"].append(np.abs(a.raw[i, hit]))
        return out if out["own"] else None

    got = meet(tiles, "variable string, own long, other long, values array<double>", schema, work, block, wanted, both=True)
    got = got.groupBy("variable", "own", "other").agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("v"))
    pick = lambda r: F.element_at("v", (F.col(r) - F.col("before") + 1).cast("int"))
    mid = own.join(got, ["variable", "own", "other"]).select("variable", "a", "b", "side", ((pick("r0") + pick("r1")) / 2).alias("m"))
    return mid.groupBy("variable", "a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("ma"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("mb"))
