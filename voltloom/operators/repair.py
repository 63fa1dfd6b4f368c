"""Fragmented series rebuilt from donors, and values outside a reference envelope repaired."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators import gram, ranks, seq
from voltloom.operators.statistics import mixed, text_code
from voltloom.session import stage

CH = ["meter_id", "variable"]


@dataclass(frozen=True)
class RepairRules:
    # fixed values: fragmentation, donors, envelope and repair
    median_island: int = 5
    longest_island: int = 60
    missing_low: float = 0.10
    missing_high: float = 0.95
    min_islands: int = 30
    min_known: int = 50
    donor_coverage: float = 0.55
    donor_common: int = 100
    donor_corr: float = 0.5
    envelope_sd: float = 1.0
    envelope_share: float = 0.45
    startup_scan: int = 700
    startup_bad: int = 30
    startup_span: int = 60
    bridge: int = 10
    clip_run: int = 1
    padding: int = 3


RULES = RepairRules()


def fragmented_series(samples: DataFrame, block: int) -> DataFrame:
    """Island statistics per channel and the verdict ``fragmented``."""
    r = RULES
    isl = seq.runs(samples, CH, F.col("value").isNotNull(), block=block).withColumnRenamed("n", "len")
    med = ranks.quantiles(isl, CH, "len", {"median_len": 0.5}).withColumnRenamed("n", "n_islands")
    top = isl.groupBy(*CH).agg(F.max("len").alias("longest"))
    miss = samples.groupBy(*CH).agg(F.count("value").alias("n_known"), (F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing"))
    bad = (
        (F.col("n_known") >= r.min_known) & (F.col("median_len") <= r.median_island) & (F.col("n_islands") >= r.min_islands)
        & F.col("missing").between(r.missing_low, r.missing_high) & (F.col("longest") < r.longest_island)
    )
    return med.join(top, CH).join(miss, CH).withColumn("fragmented", bad)


def donor_ranking(samples: DataFrame, targets: DataFrame, block: int, min_corr: float = RULES.donor_corr) -> DataFrame:
    """Donors of each target channel with correlation and linear fit, ranked by ``|r|`` then id, both falling.

    The sums of a pair come from blocked matrix products of its variable's meters (``gram``), not from its steps. Spreads are tested,
    and correlations that agree to nine decimals tie.
    """
    r = RULES
    own = samples.join(targets.select("variable").distinct(), "variable", "left_semi")
    meters = samples.select("meter_id").distinct().count()
    # both are small beside the steps; written, their sizes are known and no task sorts them for one join after the other
    sums = stage(gram.products(gram.tiled(own, block, meters), block))
    stats = own.groupBy(*CH).agg(F.min("value").alias("low"), (F.count("value") / F.count("*")).alias("known"))
    stats = stage(stats.join(targets.select(*CH, F.lit(True).alias("target")).distinct(), CH, "left"))
    turned = sums.select("variable", F.col("b").alias("a"), F.col("a").alias("b"), "n", F.col("sb").alias("sa"), F.col("sa").alias("sb"), F.col("sbb").alias("saa"), F.col("saa").alias("sbb"), "sab")
    both = gram.fitted(sums.select(turned.columns).unionByName(turned))
    both = both.withColumnsRenamed({"a": "meter_id", "b": "donor"}).withColumn("meter_id", F.col("meter_id").cast("int")).withColumn("donor", F.col("donor").cast("int"))
    both = both.join(stats.filter("target").select(*CH, "low"), CH)
    g = both.join(stats.select(F.col("meter_id").alias("donor"), "variable", F.col("low").alias("donor_low"), "known"), ["donor", "variable"])
    ok = (F.col("n") >= r.donor_common) & (F.col("known") >= r.donor_coverage) & (F.col("sd_a") >= 1e-9) & (F.col("sd_b") >= 1e-9) & (F.abs("r") >= min_corr)
    slope = F.col("cov") / (F.col("sd_b") * F.col("sd_b"))
    g = g.filter(ok).withColumn("a", slope)
    level = F.col("low") + F.col("sa") / F.col("n") - F.col("a") * (F.col("donor_low") + F.col("sb") / F.col("n"))
    w = Window.partitionBy(*CH).orderBy(F.desc(F.round(F.abs("r"), 9)), F.desc("donor"))  # a row a meter
    return g.withColumn("b", level).withColumn("rank", F.row_number().over(w)).select(*CH, "donor", F.col("n").cast("long").alias("n"), "r", "a", "b", "rank")


CASCADE = "variable string, meter_id int, x long, recon double, donor int, rank int"
CASCADE_ARROW = pa.schema([
    ("variable", pa.string()), ("meter_id", pa.int32()), ("x", pa.int64()), ("recon", pa.float64()), ("donor", pa.int32()), ("rank", pa.int32())
])


def donor_cascade(samples: DataFrame, ranking: DataFrame, main: int, block: int) -> DataFrame:
    """Missing cells of the targets predicted by the best donor that has a value, where the main meter reads.

    Targets and donors of a variable meet as the matrices of a time block: a tile of donors answers each hole of a target once.
    """
    meters = samples.select("meter_id").distinct().count()
    own = samples.join(ranking.select("variable").distinct(), "variable", "left_semi")
    tiles = stage(gram.tiled(own, block, meters))
    span = own.groupBy("variable").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-meters // gram.TILE))).cast("int")
    wanted = ranking.groupBy("variable", tile("meter_id").alias("a_tile"), tile("donor").alias("b_tile")).agg(
        F.sort_array(F.collect_list(F.struct("meter_id", "rank", "donor", "a", "b"))).alias("wanted")
    ).join(span, "variable")

    def work(row: dict, a: gram.Tile, b: gram.Tile) -> dict | None:
        at = [{int(m): k for k, m in enumerate(t.ids)} for t in (a, b)]
        out: dict[str, list] = {c: [] for c in CASCADE_ARROW.names[1:]}
        steps = row["blk"] * block + np.arange(block)
        inside = (steps >= row["first"]) & (steps <= row["last"])
        left: dict[int, np.ndarray] = {}
        for w in row["wanted"]:
            m, j = w["meter_id"], at[1].get(w["donor"])
            if j is None:
                continue
            open_ = left.setdefault(m, inside & (a.mask[at[0][m]] == 0) if m in at[0] else inside.copy())
            hit = np.flatnonzero(open_ & (b.mask[j] > 0))
            open_[hit] = False
            for c, v in zip(out, (m, steps[hit], w["a"] * b.raw[j, hit] + w["b"], w["donor"], w["rank"]), strict=True):
                out[c].append(np.broadcast_to(v, hit.shape))
        return {c: np.concatenate(v) for c, v in out.items()} if out["x"] else None

    got = gram.meet(tiles, CASCADE, CASCADE_ARROW, work, block, wanted, both=True)
    live = samples.filter((F.col("meter_id") == main) & F.col("value").isNotNull()).select("variable", "x")
    best = got.groupBy(*CH, "x").agg(F.min_by(F.struct("recon", "donor"), "rank").alias("m"))
    return best.join(live, ["variable", "x"], "left_semi").select(*CH, "x", "m.recon", "m.donor")


def reference_envelope(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Bounds per channel over a reference range: extremes widened by one sample deviation."""
    r = RULES
    ref = samples.filter(F.col("x").between(first, last))
    g = ref.groupBy(*CH).agg(
        F.count("*").alias("n_ref"), F.count("value").alias("n_known"), F.min("value").alias("lo0"), F.max("value").alias("hi0"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
    )
    need = F.greatest(F.lit(3), F.ceil(F.col("n_ref") * r.envelope_share))
    return g.filter(F.col("n_known") >= need).select(
        *CH, "n_known", (F.col("lo0") - r.envelope_sd * F.col("sd")).alias("lower"), (F.col("hi0") + r.envelope_sd * F.col("sd")).alias("upper")
    )


def repair_segments(samples: DataFrame, envelope: DataFrame, block: int) -> DataFrame:
    """Blocks outside the envelope with their action: one start-up block, short clips, longer replacements."""
    r = RULES
    bad = samples.filter(F.col("value").isNotNull()).join(envelope, CH).filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).select(*CH, "x")
    early = bad.filter(F.col("x") <= r.startup_scan).groupBy(*CH).agg(F.count("*").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    early = early.filter((F.col("c") >= r.startup_bad) & (F.col("x1") - F.col("x0") + 1 >= r.startup_span))
    start = early.select(*CH, "x0", "x1", F.lit("replace").alias("action"), F.lit("startup").alias("reason"))
    e = early.select(*CH, F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    rest = bad.join(e, CH, "left").filter(F.col("_a").isNull() | ~F.col("x").between(F.col("_a"), F.col("_b"))).select(*CH, "x")
    segs = seq.close_gaps(rest, CH, F.lit(True), r.bridge, block=block)
    one = F.col("n") <= r.clip_run
    other = segs.select(*CH, "x0", "x1", F.when(one, "clip").otherwise("replace").alias("action"), F.when(one, "point").otherwise("block").alias("reason"))
    return start.unionByName(other)


def padded(segments: DataFrame, last_x: int) -> DataFrame:
    """Replacement blocks with their residual edges; clips keep their single point."""
    wide = F.col("action") == "replace"
    return segments.withColumn("x0", F.when(wide, F.greatest(F.col("x0") - RULES.padding, F.lit(0))).otherwise(F.col("x0"))).withColumn(
        "x1", F.when(wide, F.least(F.col("x1") + RULES.padding, F.lit(last_x))).otherwise(F.col("x1"))
    )


def apply_repair(samples: DataFrame, envelope: DataFrame, first: int, last: int, last_x: int, block: int, passes: int = 2) -> DataFrame:
    """Clip points and replace blocks by the stretched reference; what remains outside is clipped at the end."""
    ref = seq.interpolate(samples.filter(F.col("x").between(first, last)), CH, "value", "v", block=block)
    ref = stage(ref.join(envelope.select(*CH), CH, "left_semi").select(*CH, (F.col("x") - first).alias("j"), "v"))
    out = samples
    for _ in range(passes):
        segs = padded(repair_segments(out, envelope, block), last_x)
        long = segs.filter("action = 'replace'").select(*CH, "x0", "x1")
        new = seq.stretch(ref, CH, long, "v", F.lit(last - first + 1)).groupBy(*CH, "x").agg(F.max_by("stretched", "x0").alias("new"))
        clip = seq.interval_points(segs.filter("action = 'clip'"), CH).select(*CH, "x", F.lit(True).alias("_clip")).distinct()
        j = out.join(new, [*CH, "x"], "left").join(clip, [*CH, "x"], "left").join(envelope.select(*CH, "lower", "upper"), CH, "left")
        held = lambda c: F.greatest(F.least(F.col(c), F.col("upper")), F.col("lower"))
        value = F.when(F.col("new").isNotNull(), held("new")).when(F.col("_clip") & F.col("value").isNotNull(), held("value")).otherwise(F.col("value"))
        out = stage(j.select(*CH, "x", value.alias("value")))
    j = out.join(envelope.select(*CH, "lower", "upper"), CH, "left")
    guarded = F.when(F.col("value").isNotNull() & F.col("lower").isNotNull(), F.greatest(F.least("value", "upper"), F.col("lower"))).otherwise(F.col("value"))
    return j.select(*CH, "x", guarded.alias("value"))


def island_overlap_add(samples: DataFrame, holes: DataFrame, block: int, seed: int = 42, overlap: float = 0.4, shortest: int = 8, reach: int = 60) -> DataFrame:
    """Values for the points of ``holes`` from hash-drawn islands of the same channel.

    Islands of at least ``shortest`` values, off their median, are laid over the hole under a raised cosine, each starting ``1 - overlap`` of
    the former's length later, on the median level of the neighbourhood. Islands and neighbourhoods are cut from block arrays; the places
    of the draws are running totals stitched from blocks, so a hole of any length is spread.
    """
    known = samples.filter(F.col("value").isNotNull())
    blocks = stage(seq.arrays(samples, CH, ["value"], block=block))
    isl = stage(seq.runs(known, CH, F.lit(True), shortest, block=block))
    pieces = isl.select(*CH, F.col("x0").alias("i0"), F.col("x0").alias("a"), F.col("x1").alias("b"))
    shapes = seq.cut(pieces, [*CH, "i0"], CH, blocks, "value", block)
    shapes = shapes.select(*CH, "i0", F.transform("value", lambda v: v - middle("value")).alias("dev"))
    order = seq.running(isl.select(*CH, F.col("x0").alias("x"), "n"), CH, {"no": F.lit(1)}, block=block)
    order = order.select(*CH, (F.col("no") - 1).alias("no"), F.col("x").alias("i0"), F.col("n").alias("k"))
    total = isl.groupBy(*CH).agg(F.count("*").alias("total"))
    gap = holes.join(total, CH, "left").withColumn("len", F.col("x1") - F.col("x0") + 1)
    least = max(1, int(shortest * (1 - overlap)))
    draw = gap.filter("total > 0").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("len") / least))))
    pick = mixed(seed, F.col("meter_id"), text_code("variable"), F.col("x0"), F.col("c"))
    draw = draw.withColumn("no", F.pmod(pick, F.col("total"))).join(order, [*CH, "no"])
    stride = F.greatest(F.lit(1), F.floor(F.col("k") * (1 - overlap)))
    draw = seq.running(draw.withColumn("stride", stride), [*CH, "x0", "x1"], {"upto": F.col("stride")}, "c", block)
    draw = draw.withColumn("pos", F.col("upto") - F.col("stride")).filter("pos < len")
    laid = draw.join(shapes, [*CH, "i0"]).select(*CH, "x0", "x1", "k", "pos", F.posexplode("dev").alias("j", "d"))
    laid = laid.withColumn("x", F.col("x0") + F.col("pos") + F.col("j")).filter("x <= x1")
    hann = 0.5 - 0.5 * F.cos(2.0 * math.pi * F.col("j") / (F.col("k") - 1))
    shape = laid.groupBy(*CH, "x0", "x1", "x").agg(F.sum(hann * F.col("d")).alias("a"), F.sum(hann).alias("w"))
    side = lambda k, a, b: holes.select(*CH, "x0", "x1", F.lit(k).alias("side"), a.alias("a"), b.alias("b"))
    near = side(0, F.greatest(F.col("x0") - reach, F.lit(0)), F.col("x0") - 1).unionByName(side(1, F.col("x1") + 1, F.col("x1") + reach))
    near = seq.cut(near, [*CH, "x0", "x1", "side"], CH, blocks, "value", block).groupBy(*CH, "x0", "x1")
    level = near.agg(F.array_compact(F.flatten(F.collect_list("value"))).alias("near"))
    level = level.select(*CH, "x0", "x1", F.when(F.size("near") > 0, middle("near")).alias("level"))
    every = seq.interval_points(gap, CH, "x0", "x1")
    j = every.join(shape, [*CH, "x0", "x1", "x"], "left").join(level, [*CH, "x0", "x1"], "left")
    value = F.coalesce(F.col("a") / F.when(F.col("w") < 1e-9, F.lit(1.0)).otherwise(F.col("w")), F.lit(0.0)) + F.coalesce("level", F.lit(0.0))
    return j.select(*CH, "x", value.alias("value"))


def middle(column: str) -> Column:
    """Median of an array without NULL."""
    order, n = F.array_sort(column), F.size(column)
    return (F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2.0


def defragment(samples: DataFrame, main: int, block: int, seed: int = 42, min_corr: float = RULES.donor_corr) -> DataFrame:
    """Cells of the fragmented channels with ``value`` and where it is from: ``observed``, ``donor``, ``islands``, ``none`` or ``no_donor``.

    Holes are filled only where the main meter reads: by the best donor that has a value, then by islands of what is known by then. A
    channel without a donor is left alone.
    """
    broken = stage(fragmented_series(samples, block).filter("fragmented").select(*CH))
    ranking = stage(donor_ranking(samples, broken, block, min_corr))
    helped = ranking.select(*CH).distinct()
    own = samples.join(broken, CH, "left_semi")
    given = donor_cascade(samples, ranking, main, block).select(*CH, "x", "recon")
    cells = own.join(helped.withColumn("helped", F.lit(True)), CH, "left").join(given, [*CH, "x"], "left")
    cells = stage(cells.select(*CH, "x", F.col("value").alias("observed"), F.coalesce("value", "recon").alias("value"), F.coalesce("helped", F.lit(False)).alias("helped")))
    live = samples.filter((F.col("meter_id") == main) & F.col("value").isNotNull()).select("variable", "x")
    rest = cells.filter("helped and value is null").join(live, ["variable", "x"], "left_semi")
    holes = seq.runs(rest, CH, F.lit(True), block=block).select(*CH, "x0", "x1")
    current = cells.filter("helped").select(*CH, "x", "value")
    with_islands = seq.runs(current, CH, F.col("value").isNotNull(), 8, block=block).select(*CH).distinct()
    made = island_overlap_add(current, stage(holes.join(with_islands, CH, "left_semi")), block, seed).withColumnRenamed("value", "laid")
    j = cells.join(made, [*CH, "x"], "left")
    kind = (
        F.when(F.col("observed").isNotNull(), "observed").when(F.col("value").isNotNull(), "donor").when(F.col("laid").isNotNull(), "islands")
        .when(F.col("helped"), "none").otherwise("no_donor")
    )
    return j.select(*CH, "x", F.coalesce("value", "laid").alias("value"), kind.alias("origin"))
