"""Gap filling by a robust level curve plus texture from the channel's own fragments.

One row per gap carries the parameters; fragments and level are joins to it. Draws are hashes of the gap,
portion and candidate, and the context is what was observed (plus micro gaps), so every gap is filled on its
own, in any order, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions import scalars
from voltloom.functions.numeric import fixed
from voltloom.functions.slopes import theil_sen
from voltloom.functions.textures import chord_shape, from_chord, two_sided_shape
from voltloom.operators import joins, ranks, seq
from voltloom.operators.statistics import PRIME, adjust, ks_two_sample, mixed, text_code, wilcoxon
from voltloom.session import stage

CH = ["meter_id", "variable"]
GAP = [*CH, "x0", "x1"]
FLAGS = ["edge_risk", "regime", "low_conf"]
#: Numbers of starts that one bucket of a fragment index spans.
STRIDE = 64


@dataclass(frozen=True)
class FillRules:
    # fixed values: parameters of the fill
    micro: int = 2
    min_fragment: int = 3
    min_obs: int = 12
    lateral: int = 600
    near: int = 6
    edge_z: float = 4.0
    drift: float = 2.0
    drift_length: float = 342.0
    regime: float = 4.0
    regime_length: int = 180
    slope_risk: float = 3.0
    long_gap: int = 720
    max_portion: int = 120
    candidates: int = 8
    w_freq: float = 1.833039
    w_amp: float = 0.636921
    w_slope: float = 1.018538
    w_level: float = 1.777577
    envelope: float = 4.553440
    margin: float = 0.05
    support_share: float = 0.85
    support_min: int = 3
    support_reuse: int = 5
    tiny: float = 1e-9
    min_context: int = 4
    texture_length: int = 6
    texture_draws: int = 64


RULES = FillRules()


def bordered_gaps(samples: DataFrame, block: int) -> DataFrame:
    """Gaps with the values next to them (NULL at the ends of a channel)."""
    g = seq.runs(samples, CH, F.col("value").isNull(), block=block)
    known = samples.filter(F.col("value").isNotNull())
    left = known.select(*CH, (F.col("x") + 1).alias("x0"), F.col("value").alias("vb"))
    right = known.select(*CH, (F.col("x") - 1).alias("x1"), F.col("value").alias("va"))
    return g.join(left, [*CH, "x0"], "left").join(right, [*CH, "x1"], "left")


def micro_fill(samples: DataFrame, gaps: DataFrame) -> DataFrame:
    """Samples with the inner gaps of one or two steps on a straight line; ``origin`` is obs, micro or NULL."""
    small = gaps.filter((F.col("n") <= RULES.micro) & F.col("vb").isNotNull() & F.col("va").isNotNull())
    pts = seq.interval_points(small, CH, "x0", "n", "vb", "va")
    line = F.col("vb") + (F.col("va") - F.col("vb")) * (F.col("x") - F.col("x0") + 1) / (F.col("n") + 1)
    j = samples.join(pts.select(*CH, "x", line.alias("_line")), [*CH, "x"], "left")
    origin = F.when(F.col("value").isNotNull(), "obs").when(F.col("_line").isNotNull(), "micro")
    return j.select(*CH, "x", F.coalesce("value", "_line").alias("value"), origin.alias("origin"))


def fragment_library(known: DataFrame, block: int) -> DataFrame:
    return seq.runs(known, CH, F.col("value").isNotNull(), RULES.min_fragment, block=block)


def fragment_index(library: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """Where the starts of fragments of each wanted length ``(channel, len)`` stand: rank and select by runs.

    A run with room for a length offers ``n - len + 1`` starts, which are numbered along the series; a row holds the numbers ``[low, high)``
    of one run under one bucket of ``STRIDE`` numbers, beside the channel's ``n_starts``. No start has a row of its own, and the running
    totals are stitched from blocks.
    """
    room = library.join(lengths, CH).filter(F.col("n") >= F.col("len")).withColumn("w", F.col("n") - F.col("len") + 1)
    total = room.groupBy(*CH, "len").agg(F.sum("w").alias("n_starts"))
    along = seq.running(room.select(*CH, "len", "x0", "w"), [*CH, "len"], {"high": F.col("w")}, "x0", block)
    along = along.select(*CH, "len", F.col("x0").alias("run0"), (F.col("high") - F.col("w")).alias("low"), "high").join(total, [*CH, "len"])
    buckets = F.sequence(F.floor(F.col("low") / STRIDE), F.floor((F.col("high") - 1) / STRIDE))
    return along.withColumn("bucket", F.explode(buckets))


def select_starts(draws: DataFrame, index: DataFrame) -> DataFrame:
    """``draws`` (channel, len, draw) with the step ``start`` at which the drawn fragment begins; lengths nowhere available are left out."""
    counts = index.select(*CH, "len", "n_starts").distinct()
    numbered = draws.join(counts, [*CH, "len"]).withColumn("pick", F.pmod("draw", "n_starts"))
    numbered = numbered.withColumn("bucket", F.floor(F.col("pick") / STRIDE))
    met = numbered.join(index.drop("n_starts"), [*CH, "len", "bucket"]).filter((F.col("pick") >= F.col("low")) & (F.col("pick") < F.col("high")))
    return met.withColumn("start", F.col("run0") + F.col("pick") - F.col("low")).drop("bucket", "low", "high", "run0", "n_starts", "draw")


def series_texture(library: DataFrame, blocks: DataFrame, seed: int, block: int) -> DataFrame:
    """``s_amp, s_freq`` per channel: medians of spread and turning share over drawn fragments, off their chords; 0 without any."""
    r = RULES
    channels = blocks.select(*CH).distinct()
    asked = channels.withColumn("len", F.lit(r.texture_length).cast("long"))
    draws = asked.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(r.texture_draws - 1))))
    draws = draws.withColumn("draw", mixed(seed, F.col("meter_id"), text_code("variable"), F.col("no")))
    found = select_starts(draws, fragment_index(library, asked, block))
    pieces = found.select(*CH, "no", F.col("start").alias("a"), (F.col("start") + r.texture_length - 1).alias("b"))
    frag = seq.cut(pieces, [*CH, "no"], CH, blocks, "value", block).withColumn("shape", chord_shape("value"))
    mid = frag.groupBy(*CH).agg(F.percentile("shape.sd", F.lit(0.5)).alias("s_amp"), F.percentile("shape.freq", F.lit(0.5)).alias("s_freq"))
    return channels.join(mid, CH, "left").na.fill(0.0, ["s_amp", "s_freq"])


def portions(gaps: DataFrame, bands: Sequence[tuple]) -> DataFrame:
    """Category, number of portions and portion length of each gap."""
    g = joins.band_lookup(gaps, "n", bands)
    many = F.when(F.col("n") > 360, F.greatest("portions", F.ceil(F.col("n") / RULES.max_portion))).otherwise(F.col("portions"))
    g = g.withColumn("portions", many.cast("int"))
    return g.withColumn("plen", F.greatest(F.lit(RULES.min_fragment), F.ceil(F.col("n") / F.col("portions"))).cast("long"))


def level_parameters(gaps: DataFrame, blocks: DataFrame, channel_mad: DataFrame, block: int) -> DataFrame:
    """Per inner gap: lateral medians, spreads and slopes, closing values, near shape and risk flags.

    Both contexts are cut from the block arrays next to the gap.
    """
    r = RULES
    side = lambda k, a, b: gaps.select(*GAP, F.lit(k).alias("side"), a.alias("a"), b.alias("b"))
    left = side(0, F.greatest(F.col("x0") - r.lateral, F.lit(0)), F.col("x0") - 1)
    right = side(1, F.col("x1") + 1, F.col("x1") + r.lateral)
    parts = seq.cut(left.unionByName(right), [*GAP, "side"], CH, blocks, "value", block)
    # arrays of at most 600 steps a side
    ctx = parts.groupBy(*GAP).agg(*[F.max(F.when(F.col("side") == k, F.col("value"))).alias(c) for k, c in enumerate("LR")])
    near_l, near_r = F.slice("L", -F.least(F.size("L"), F.lit(r.near)), r.near), F.slice("R", 1, r.near)
    ctx = ctx.select(*GAP, *[F.array_compact(c).alias(n) for c, n in (("L", "l"), ("R", "r"), (near_l, "nl"), (near_r, "nr"))])
    mid = lambda c: F.when(F.size(c) > 0, _median(c))
    ctx = ctx.withColumn("m_l", mid(F.col("l"))).withColumn("m_r", mid(F.col("r")))
    spread = lambda c, m: 1.4826 * mid(F.transform(F.col(c), lambda e: F.abs(e - F.col(m)))) + r.tiny
    ctx = ctx.withColumn("s_l", spread("l", "m_l")).withColumn("s_r", spread("r", "m_r"))
    ctx = ctx.select(
        *GAP, "m_l", "m_r", "s_l", "s_r", theil_sen("l").alias("b_l"), theil_sen("r").alias("b_r"),
        theil_sen("nl").alias("nb_l"), theil_sen("nr").alias("nb_r"), two_sided_shape("nl", "nr").alias("shape"),
        ((F.size("l") >= 3) & (F.size("r") >= 3)).alias("wide"),
    )
    g = gaps.join(ctx, GAP, "left").join(channel_mad, CH, "left")
    n = F.col("n").cast("double")
    agree = F.exp(-F.abs(F.col("b_l") - F.col("b_r")) / (F.abs("b_l") + F.abs("b_r") + r.tiny))
    damp = 1.0 / (1.0 + (n / r.drift_length) * (n / r.drift_length))
    cap = r.drift * 0.5 * (F.col("s_l") + F.col("s_r")) / n
    slope = F.greatest(F.least(damp * agree * 0.5 * (F.col("b_l") + F.col("b_r")), cap), -cap)
    mad = F.greatest(F.col("shape.mad"), F.col("mad_series"), F.lit(r.tiny))
    regime = (F.abs(F.col("va") - F.col("vb")) / mad > r.regime) & (F.col("n") >= r.regime_length)
    return (
        g.withColumn("wide", F.coalesce("wide", F.lit(False)))
        .withColumn("close_b", F.when(F.abs(F.col("vb") - F.col("m_l")) / F.col("s_l") <= r.edge_z, F.col("vb")).otherwise(F.col("m_l")))
        .withColumn("close_a", F.when(F.abs(F.col("va") - F.col("m_r")) / F.col("s_r") <= r.edge_z, F.col("va")).otherwise(F.col("m_r")))
        .withColumn("beta", slope)
        .withColumn("edge_risk", F.coalesce((F.abs("nb_l") * n > r.slope_risk * mad) | (F.abs("nb_r") * n > r.slope_risk * mad), F.lit(False)))
        .withColumn("regime", F.coalesce(regime, F.lit(False)))
        .withColumn("low_conf", (F.col("n") > r.long_gap) | F.col("regime"))
    )


def _median(c) -> Column:
    s = F.array_sort(c)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2.0


def level_curve(params: DataFrame, line: bool = False) -> DataFrame:
    """The level at every point of every inner gap. ``line`` keeps the straight connection of the borders."""
    pts = params.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("o", F.col("x") - F.col("x0"))
    n = F.col("n").cast("double")
    straight = F.col("vb") + (F.col("va") - F.col("vb")) * (F.col("o") + 1) / (n + 1)
    if line:
        return pts.withColumn("base", straight)
    u = F.when(n > 1, F.col("o") / F.greatest(n - 1, F.lit(1.0))).otherwise(F.lit(0.0))
    trend = lambda o, h: F.col("m_l") + (F.col("m_r") - F.col("m_l")) * h + F.col("beta") * (o - n / 2.0)
    first, last = trend(F.lit(0.0), F.lit(0.0)), trend(n - 1, F.when(n > 1, 1.0).otherwise(0.0))
    q = F.least(F.lit(0.10), 60.0 / n)
    w_l = F.when(u < q, 1.0 - scalars.smoothstep(u / q)).otherwise(F.lit(0.0))
    w_r = F.when(u > 1.0 - q, scalars.smoothstep((u - (1.0 - q)) / q)).otherwise(F.lit(0.0))
    curve = trend(F.col("o"), scalars.smoothstep(u)) + w_l * (F.col("close_b") - first) + w_r * (F.col("close_a") - last)
    return pts.withColumn("base", F.when(F.col("wide"), curve).otherwise(straight))


SCANNED = "meter_id int, variable string, plen long, blk long, inner int, through boolean, leave int, counts array<int>, exits array<int>"


def scanned(known: np.ndarray, observed: np.ndarray, size: int, plen: int, continued: bool) -> tuple[int, bool, int, list[int], list[int]]:
    """What the half-step scan with windows of ``plen`` does in a block of ``size`` steps, for every state in which it may enter.

    ``known`` and ``observed`` go on for ``plen`` steps after the block. A run that begins inside is scanned from there: ``inner`` counts its
    windows, ``leave`` is the offset in the next block at which the scan of the last one goes on (-1: not at all). For a run that comes from the
    block before, ``counts`` and ``exits`` say the same for each offset of entry; ``through`` means that it is also the one that leaves.
    """
    whole = np.append(known, np.zeros(max(0, size + plen - len(known)), bool))
    total = np.append(0, np.cumsum(np.append(observed, np.zeros(len(whole) - len(observed), bool))))
    at = np.arange(size)
    holes = np.append(np.flatnonzero(~whole), len(whole))
    room = holes[np.searchsorted(holes, at)] - at  # known steps from here
    share = (total[at + plen] - total[at]) / plen
    step = np.where(share >= RULES.support_share, plen, max(1, plen // 2))
    hit, fits = share >= RULES.support_share, room >= plen
    first = np.flatnonzero(whole[:size] & ~np.append(continued, whole[: size - 1]))
    p = np.append(first, np.arange(plen) if continued else [])
    p = p.astype(np.int64)
    count = np.zeros(len(p), np.int64)
    while True:
        own = np.flatnonzero(p < size)
        own = own[(p[own] >= 0) & fits[np.minimum(p[own], size - 1)]] if len(own) else own
        if not len(own):
            break
        count[own] += hit[p[own]]
        p[own] += step[p[own]]
    exits = np.where(p >= size, p - size, -1)
    n, leaves = len(first), bool(whole[size - 1] and len(whole) > size and whole[size])
    through = leaves and continued and not (~whole[:size]).any()
    leave = int(exits[n - 1]) if leaves and not through and n else -1
    return int(count[:n].sum()), through, leave, count[n:].tolist(), exits[n:].tolist()


def scan_tables(blocks: DataFrame, need: DataFrame, block: int) -> DataFrame:
    """The transition table of every (channel, block, portion length) of ``blocks`` (value, origin arrays)."""
    own = blocks.select(*CH, "_blk", F.transform("value", lambda v: v.isNotNull()).alias("k"), F.transform("origin", lambda o: o.eqNullSafe(F.lit("obs"))).alias("o"))
    plens = need.groupBy(*CH).agg(F.sort_array(F.collect_set("plen")).alias("plens"))
    reach = F.array_max("plens").cast("int")
    after = own.select(*CH, (F.col("_blk") - 1).alias("_blk"), F.col("k").alias("k1"), F.col("o").alias("o1"))
    before = own.select(*CH, (F.col("_blk") + 1).alias("_blk"), F.element_at("k", -1).alias("continued"))
    met = own.join(plens, CH).join(after, [*CH, "_blk"], "left").join(before, [*CH, "_blk"], "left")
    met = met.select(*CH, "_blk", "k", "o", "plens", F.slice("k1", 1, reach).alias("k1"), F.slice("o1", 1, reach).alias("o1"), F.coalesce("continued", F.lit(False)).alias("continued"))
    schema = pa.schema([
        ("meter_id", pa.int32()), ("variable", pa.string()), ("plen", pa.int64()), ("blk", pa.int64()), ("inner", pa.int32()), ("through", pa.bool_()),
        ("leave", pa.int32()), ("counts", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                known, seen = np.array(r["k"] + (r["k1"] or []), bool), np.array(r["o"] + (r["o1"] or []), bool)
                size = len(r["k"])
                for plen in r["plens"]:
                    some = scanned(known[: size + plen], seen[: size + plen], size, plen, bool(r["continued"] and r["k"][0]))
                    rows.append((r["meter_id"], r["variable"], plen, r["_blk"], *some))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows) if rows else [()] * len(schema.names))), schema=schema)

    return met.mapInArrow(run, SCANNED)


def capacity(tables: DataFrame) -> DataFrame:
    """``cap`` per (channel, plen): the transition tables composed along the series."""
    chain = tables.groupBy(*CH, "plen").agg(F.sort_array(F.collect_list(F.struct("blk", "inner", "through", "leave", "counts", "exits"))).alias("t"))
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("cap"))

    def step(acc, e):
        came = (acc["at"] >= 0) & (F.size(e["counts"]) > 0)
        more = F.when(came, F.get(e["counts"], acc["at"])).otherwise(F.lit(0))
        at = F.when(e["through"], F.when(came, F.get(e["exits"], acc["at"])).otherwise(F.lit(-1))).otherwise(e["leave"])
        return F.struct(at.alias("at"), (acc["cap"] + e["inner"] + more).cast("long").alias("cap"))

    return chain.select(*CH, "plen", F.aggregate("t", zero, step)["cap"].alias("cap"))


def supported(gaps: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Gaps whose portion length fits often enough into mostly observed stretches.

    Every run of known values is scanned from its start: a window with enough observed steps counts and is passed, any other is left by half
    its length. The scan is sequential along a run; blocks do it for every state of entry, and their tables are composed.
    """
    r = RULES
    cap = capacity(scan_tables(blocks, gaps.select(*CH, "plen").distinct(), block))
    j = gaps.join(cap, [*CH, "plen"], "left").withColumn("cap", F.coalesce("cap", F.lit(0)))
    reuse = F.ceil(F.col("n") / F.col("plen")) / F.greatest("cap", F.lit(1))
    return j.withColumn("supported", (F.col("cap") >= r.support_min) & (reuse <= r.support_reuse))


def pick_fragments(gaps: DataFrame, blocks: DataFrame, library: DataFrame, seed: int, block: int, freq_only: bool = False) -> DataFrame:
    """Best of eight drawn fragments per portion with its ``cost`` and its deviations from the chord; ties go to the earlier draw."""
    r = RULES
    hop = F.greatest(F.lit(1), F.floor(F.col("plen") / 2)).cast("long")
    p = gaps.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, hop)))
    p = p.withColumn("len", F.least("plen", F.col("n") - F.col("pos"))).filter(F.col("len") >= r.min_fragment)
    p = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(r.candidates - 1))))
    p = p.withColumn("draw", mixed(seed, F.col("meter_id"), text_code("variable"), F.col("x0"), F.col("pos"), F.col("c")))
    drawn = stage(select_starts(p.select(*GAP, "pos", "len", "c", "sig", "fc", "m_gap", "draw"), fragment_index(library, p.select(*CH, "len").distinct(), block)))
    ids = [*CH, "start", "len"]  # a fragment that several portions drew is cut and measured once
    pieces = drawn.select(*ids).distinct().withColumn("a", F.col("start")).withColumn("b", F.col("start") + F.col("len") - 1)
    frag = seq.cut(pieces, ids, CH, blocks, "value", block)
    frag = stage(frag.withColumn("shape", chord_shape("value")).withColumn("slope", theil_sen("value")))
    rise = F.element_at("value", -1) - F.element_at("value", 1)
    measured = frag.select(*ids, F.col("shape.freq").alias("f"), F.col("shape.sd").alias("sd"), "slope", rise.alias("rise"))
    j = drawn.join(measured, ids)
    eps = F.col("sig") + r.tiny
    cost = F.abs(F.col("f") - F.col("fc"))
    if not freq_only:
        cost = (
            r.w_freq * cost + r.w_amp * F.abs(F.col("sd") - F.col("sig")) / eps
            + r.w_slope * F.abs(F.col("slope") - F.col("m_gap")) * F.col("len") / eps
            + r.w_level * F.abs(F.col("rise") - F.col("m_gap") * F.col("len")) / eps
        )
    best = j.groupBy(*GAP, "pos", "len").agg(F.min(F.struct(fixed(cost, 6).alias("cost"), "c", "start")).alias("m")).select(*GAP, "pos", "len", "m.cost", "m.start")
    return best.join(frag.select(*ids, from_chord("value").alias("dev")), ids)


def texture(fragments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Overlap-add of the fragments under a raised cosine, off its chord, scaled to the wanted spread and cut at the envelope."""
    r = RULES
    pts = fragments.select(*GAP, "pos", "len", F.posexplode("dev").alias("i", "d"))
    w = F.when(F.col("len") > 2, 0.5 - 0.5 * F.cos(2.0 * math.pi * F.col("i") / (F.col("len") - 1))).otherwise(F.lit(1.0))
    add = pts.withColumn("o", F.col("pos") + F.col("i")).groupBy(*GAP, "o").agg(F.sum(w * F.col("d")).alias("a"), F.sum(w).alias("w"))
    add = add.withColumn("t", F.col("a") / F.when(F.col("w") < 1e-9, F.lit(1.0)).otherwise(F.col("w")))
    every = gaps.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(*GAP, "n", "amp", "o")
    full = every.join(add.select(*GAP, "o", "t"), [*GAP, "o"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    ends = full.groupBy(*GAP).agg(F.min_by("t", "o").alias("t0"), F.max_by("t", "o").alias("t1"))
    n1 = F.greatest(F.col("n") - 1, F.lit(1))
    full = full.join(ends, GAP).withColumn("t", F.col("t") - (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("o") / n1))
    sd = full.groupBy(*GAP).agg(F.stddev_pop("t").alias("sd")).filter(F.col("sd") >= r.tiny)
    lim = r.envelope * F.col("amp")
    scaled = F.col("t") / F.col("sd") * F.col("amp")
    return full.join(sd, GAP).select(*GAP, "o", F.greatest(F.least(scaled, lim), -lim).alias("tex"))


def range_guard(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Shrink the deviation of each gap from its level, which is cut to the observed range first, until it fits; cut what remains."""
    j = points.join(bounds, CH).withColumn("base", F.greatest(F.least("base", "hi"), F.col("lo")))
    d = F.col("cand") - F.col("base")
    room = F.when(d > 1e-12, (F.col("hi") - F.col("base")) / d).when(d < -1e-12, (F.col("lo") - F.col("base")) / d)
    scale = j.groupBy(*GAP).agg(F.min(room).alias("_s"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_s", F.lit(1.0))))
    out = j.join(scale, GAP).withColumn("scale", s)
    y = F.col("base") + F.col("scale") * d
    room = 1e-9 * (F.col("hi") - F.col("lo"))  # the point that sets the scale lies on the bound, but for rounding
    clipped = (y < F.col("lo") - room) | (y > F.col("hi") + room)
    return out.withColumn("clipped", clipped).withColumn("y", F.greatest(F.least(y, F.col("hi")), F.col("lo")))


def edge_points(gaps: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """Leading and trailing gaps: the neighbouring stretch, tiled, off its chord, on the border value.

    The known values of a channel carry ordinals stitched from blocks. The stretch of a gap is a range of ordinals, and a point of the gap reads
    the one that its offset leaves modulo their number; neither needs an order over the gap.
    """
    r = RULES
    g = gaps.filter(F.col("vb").isNull() != F.col("va").isNull()).withColumn("anchor", F.coalesce("va", "vb"))
    lead = F.col("vb").isNull()
    g = g.withColumn("a", F.when(lead, F.col("x1") + 1).otherwise(F.greatest(F.lit(0), F.col("x0") - F.col("n"))))
    g = g.withColumn("b", F.when(lead, F.col("x1") + F.col("n")).otherwise(F.col("x0") - 1))
    solid = known.filter("value is not null").select(*CH, "x", "value").join(g.select(*CH).distinct(), CH, "left_semi")
    solid = stage(seq.running(solid, CH, {"no": F.lit(1)}, block=block).select(*CH, "x", "value", "no"))
    src = solid.join(g.select(*GAP, "n", "a", "b"), CH).filter(F.col("x").between(F.col("a"), F.col("b")))  # one gap at either end
    size = src.groupBy(*GAP, "n").agg(F.count("*").alias("m"), F.stddev_pop("value").alias("sd"), F.min("no").alias("no0"), F.min_by("value", "x").alias("f0"))
    size = size.withColumn("last_no", F.col("no0") + F.pmod(F.col("n") - 1, F.col("m")))
    tail = solid.select(*CH, F.col("no").alias("last_no"), F.col("value").alias("f1"))
    size = size.join(tail, [*CH, "last_no"]).drop("last_no", "n")
    pts = g.drop("a", "b").withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("o", F.col("x") - F.col("x0")).join(size, GAP, "left")
    rich = F.coalesce((F.col("m") >= r.min_fragment) & (F.col("sd") > r.tiny), F.lit(False))
    pts = pts.withColumn("rich", rich).withColumn("no", F.when(F.col("rich"), F.col("no0") + F.pmod(F.col("o"), F.col("m"))))
    pts = pts.join(solid.select(*CH, "no", F.col("value").alias("v")), [*CH, "no"], "left")
    chord = F.col("f0") + (F.col("f1") - F.col("f0")) * F.col("o") / F.greatest(F.col("n") - 1, F.lit(1))
    cand = F.when(F.col("rich") & (F.col("n") >= 2), F.col("anchor") + F.col("v") - chord).otherwise(F.col("anchor"))
    kind = F.when(F.col("rich"), "analog").otherwise("edge")
    code = scalars.confidence_code("category", F.lit(False))
    none = F.lit(False)
    return pts.select(
        *GAP, "x", F.col("anchor").alias("base"), cand.alias("cand"), kind.alias("kind"), code.alias("code"),
        none.alias("edge_risk"), none.alias("regime"), none.alias("low_conf"),
    )


def analog_fill(samples: DataFrame, bands: Sequence[tuple], block: int, seed: int = 42, backbone: str = "trend", criteria: str = "multi") -> DataFrame:
    """Every cell with its filled value, confidence code and kind of fill.

    ``backbone="line"`` and ``criteria="freq"`` give the older straight-line, frequency-only method.
    """
    p = fill_plan(samples, bands, block, seed, backbone, criteria)
    return filled_cells(samples, p, fill_points(p, backbone == "line"))


def fill_points(p: dict, line: bool = False) -> DataFrame:
    """Every point of every gap with its guarded value ``y``, kind, code and flags."""
    curve = level_curve(p["params"], line).join(p["texture"], [*GAP, "o"], "left")
    code = F.when(F.col("bare"), 6).otherwise(scalars.confidence_code("category", "low_conf"))
    kind = F.when(F.col("bare"), "unsupported").when(F.col("tex").isNotNull(), "analog").otherwise("interp")
    body = curve.select(
        *GAP, "x", "base", (F.col("base") + F.coalesce("tex", F.lit(0.0))).alias("cand"), kind.alias("kind"), code.alias("code"), *FLAGS,
    )
    return range_guard(body.unionByName(edge_points(p["gaps"], p["known"], p["block"])), p["live"].select(*CH, "lo", "hi"))


def filled_cells(samples: DataFrame, p: dict, points: DataFrame) -> DataFrame:
    made = points.select(*CH, "x", "y", "kind", "code", "scale", "clipped", *FLAGS)
    known = p["known"].select(*CH, "x", F.col("value").alias("k"), "origin")
    j = samples.withColumnRenamed("value", "observed").join(known, [*CH, "x"], "left").join(made, [*CH, "x"], "left")
    return j.select(
        *CH, "x", "observed", F.coalesce("observed", "k", "y").alias("value"),
        F.when(F.col("observed").isNotNull(), 0).when(F.col("origin") == "micro", 1).otherwise(F.coalesce("code", F.lit(5))).cast("byte").alias("code"),
        F.when(F.col("observed").isNotNull(), "observed").when(F.col("origin") == "micro", "interp").otherwise(F.coalesce("kind", F.lit("unfilled"))).alias("kind"),
        F.coalesce(F.col("scale") < 0.999999, F.lit(False)).alias("rescaled"), F.coalesce("clipped", F.lit(False)).alias("clipped"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS],
    )


def live_channels(samples: DataFrame) -> DataFrame:
    """Channels with enough readings: their median deviation and the range a filled value may take."""
    r = RULES
    stats = ranks.median_mad(samples, CH, "value").select(*CH, F.col("n").alias("n_obs"), F.col("mad").alias("mad_series"))
    span = samples.groupBy(*CH).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.stddev_pop("value").alias("sd"))
    margin = r.margin * F.greatest(F.col("b") - F.col("a"), F.col("sd"), F.lit(r.tiny))
    bounds = span.select(*CH, (F.col("a") - margin).alias("lo"), (F.col("b") + margin).alias("hi"))
    return stats.filter(F.col("n_obs") >= r.min_obs).join(bounds, CH)


def fill_plan(samples: DataFrame, bands: Sequence[tuple], block: int, seed: int = 42, backbone: str = "trend", criteria: str = "multi") -> dict:
    """The parts of a fill: ``known`` (micro-filled cells), ``blocks`` (its arrays), ``gaps``, ``library``, ``live``, ``params`` (a row for each inner
    gap), ``picks`` (a fragment for each portion) and ``texture`` (a value for each textured point)."""
    r = RULES
    live = stage(live_channels(samples))
    use = samples.join(live.select(*CH), CH, "left_semi")
    known = stage(micro_fill(use, bordered_gaps(use, block)))
    blocks = stage(seq.arrays(known, CH, ["value", "origin"], block=block))
    gaps = stage(portions(bordered_gaps(known, block), bands))
    library = stage(fragment_library(known, block))
    inner = gaps.filter("vb is not null and va is not null")
    params = level_parameters(inner, blocks, live.select(*CH, "mad_series"), block)
    params = supported(params, blocks, block).join(series_texture(library, blocks, seed, block), CH)
    rich = (F.coalesce("shape.n", F.lit(0)) >= r.min_context) & (F.col("shape.sd") > r.tiny)
    params = stage(
        params.withColumn("bare", (F.col("n") > bands[0][2]) & ~F.col("supported"))
        .withColumn("sig", F.when(rich, F.col("shape.sd")).otherwise(F.col("s_amp")))
        .withColumn("fc", F.when(rich, F.col("shape.freq")).otherwise(F.col("s_freq")))
        .withColumn("amp", F.when(rich, F.col("shape.sd") * scalars.k_of_length("n")).otherwise(F.col("s_amp")))
        .withColumn("m_gap", (F.col("va") - F.col("vb")) / (F.col("n") + 1))
    )
    textured = params.filter(~F.col("bare") & (F.col("amp") > r.tiny))
    picks = stage(pick_fragments(textured, blocks, library, seed, block, criteria == "freq"))
    return {"block": block, "known": known, "blocks": blocks, "gaps": gaps, "library": library, "live": live, "params": params, "picks": picks, "texture": stage(texture(picks, textured))}


def fill_trace(filled: DataFrame) -> DataFrame:
    """Cells per kind of fill and channel, and cells in gaps with each risk flag."""
    kinds = ("observed", "analog", "interp", "edge", "unsupported", "unfilled")
    return filled.groupBy(*CH).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        F.count_if("rescaled").alias("n_rescaled"), F.count_if("clipped").alias("n_clipped"), *[F.count_if(c).alias(f"n_{c}") for c in FLAGS],
    )


def heldout_windows(samples: DataFrame, sizes: Sequence[int], share: float, seed: int) -> DataFrame:
    """A hash sample, by share, of the windows of each size that are half observed with both neighbours observed, as ``(size, channel, x0, x1, n_obs)``.

    Every second tile of ``size`` steps is a candidate, so hidden windows of a size never touch.
    """
    known = samples.filter(F.col("value").isNotNull()).select(*CH, "x")
    sized = known.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("tile", F.floor(F.col("x") / F.col("size")).cast("long"))
    dense = sized.filter("tile % 2 = 1").groupBy("size", *CH, "tile").agg(F.count("*").alias("n_obs"))
    dense = dense.filter(F.col("n_obs") >= 0.5 * F.col("size")).withColumn("x0", F.col("tile") * F.col("size")).withColumn("x1", F.col("x0") + F.col("size") - 1)
    left = known.select(*CH, (F.col("x") + 1).alias("x0"))
    right = known.select(*CH, (F.col("x") - 1).alias("x1"))
    ok = dense.join(left, [*CH, "x0"], "left_semi").join(right, [*CH, "x1"], "left_semi")
    key = mixed(seed, F.col("size"), F.col("meter_id"), text_code("variable"), F.col("x0"))
    return ok.filter(key < F.lit(int(share * PRIME))).select("size", *CH, "x0", "x1", "n_obs")


def virtual(name: str = "variable", size: str = "size") -> Column:
    """A channel's name as one of the series of a held-out proof: one for each size."""
    return F.concat(F.col(name), F.lit("@"), F.col(size).cast("string"))


def hide(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Each channel once for every size it has windows of, as a series of its own, without the values of these windows."""
    pts = seq.interval_points(windows.withColumn("variable", virtual()), CH).withColumn("_hide", F.lit(True))
    each = samples.join(windows.select(*CH, "size").distinct(), CH).withColumn("variable", virtual()).select(*CH, "x", "value")
    j = each.join(pts, [*CH, "x"], "left")
    return j.select(*CH, "x", F.when(F.col("_hide").isNull(), F.col("value")).alias("value"))


SCORES = ("sd_ratio", "freq_ratio", "energy_ratio", "mae", "ks_p")


def fill_scores(truth: DataFrame, filled: DataFrame, windows: DataFrame, method: str) -> DataFrame:
    """Spread, frequency and energy ratios, mean absolute error and distribution distance per hidden window ``(size, channel, x0)``.

    ``filled`` holds the series that ``hide`` made.
    """
    pts = seq.interval_points(windows, CH, "size", "x0").join(truth.filter(F.col("value").isNotNull()).select(*CH, "x", F.col("value").alias("t")), [*CH, "x"])
    own = filled.select("meter_id", F.col("variable").alias("series"), "x", F.col("value").alias("f"))
    j = pts.withColumn("series", virtual()).join(own, ["meter_id", "series", "x"]).drop("series")
    keys = ["size", *CH, "x0"]
    zero = F.lit(0.0)
    line = lambda c: F.sort_array(F.collect_list(F.struct("x", c)))[c]  # noqa: E731 - at most a window
    g = j.groupBy(*keys).agg(
        # equal values that meet from several tasks may get a spread of their last digit
        F.when(F.min("t") < F.max("t"), F.stddev_pop("f") / F.nullif(F.stddev_pop("t"), zero)).alias("sd_ratio"), ((F.sum(F.abs("f")) + 1e-12) / (F.sum(F.abs("t")) + 1e-12)).alias("energy_ratio"),
        F.avg(F.abs(F.col("f") - F.col("t"))).alias("mae"), F.count("*").alias("n"), line("t").alias("_t"), line("f").alias("_f"),
    )
    g = g.withColumn("freq_ratio", turning("_f") / F.nullif(turning("_t"), zero)).drop("_t", "_f")
    both = j.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("v"), F.lit(True).alias("a")), F.struct(F.col("f").alias("v"), F.lit(False).alias("a")))).alias("s"))
    ks = ks_two_sample(both.select(*keys, "s.v", "s.a"), keys, "v", F.col("a"))
    return g.join(ks.select(*keys, F.col("d").alias("ks_d"), F.col("p_value").alias("ks_p")), keys).withColumn("method", F.lit(method))


def turning(values: str) -> Column:
    """Share of the inner values of a short array at which its direction changes."""
    n = F.size(values)
    sign = lambda i: F.signum(F.get(values, i) - F.get(values, i - 1))
    inner = F.sequence(F.lit(1), n - 2)
    return F.when(n < 3, 0.0).otherwise(F.size(F.filter(inner, lambda i: sign(i + 1) != sign(i))) / (n - 2))


def score_summary(scores: DataFrame) -> DataFrame:
    """Quantiles of every score per size and method, and the share of windows whose distribution differs at five per cent."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("v")) for c in SCORES]))
    long = scores.select("size", "method", cells.alias("c")).select("size", "method", "c.score", "c.v")
    q = ranks.quantiles(long, ["size", "method", "score"], "v", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    unlike = scores.groupBy("size", "method").agg(F.avg((F.col("ks_p") < 0.05).cast("double")).alias("differing"))
    return q.join(unlike, ["size", "method"])


def method_tests(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Paired tests of two methods on the distance of the ratios from one and on the error, adjusted within each size."""
    marks = {"sd": F.abs(F.col("sd_ratio") - 1), "freq": F.abs(F.col("freq_ratio") - 1), "energy": F.abs(F.col("energy_ratio") - 1), "mae": F.col("mae")}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in marks.items()]))
    long = scores.select("size", *CH, "x0", "method", cells.alias("c")).select("size", *CH, "x0", "method", "c.metric", "c.v")
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("v")))
    pair = long.groupBy("size", *CH, "x0", "metric").agg((of(a) - of(b)).alias("diff"))
    return adjust(wilcoxon(pair, ["size", "metric"], "diff"), family=["size"])
