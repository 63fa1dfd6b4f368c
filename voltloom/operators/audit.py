"""Physical and informational audit of channels; verdicts only, no data is changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import AUDIT
from voltloom.functions import names
from voltloom.functions.numeric import ratio, safe_corr, share
from voltloom.operators import aggregate, ranks
from voltloom.session import stage

PHASES = ("a", "b", "c")
CH = ["meter_id", "variable"]


def by_phase(wide: DataFrame, harmonics: Sequence[str]) -> DataFrame:
    """Three rows per reading, one per phase, with the quantities of that phase."""
    rows = []
    for p in PHASES:
        own = [F.col(h) for h in harmonics if f"_{p}n_" in h]
        rows.append(
            F.struct(
                F.lit(p.upper()).alias("phase"),
                *[F.col(f"{q}_{p}").alias(q) for q in ("p", "q", "s", "cos", "thdi", "thdv")],
                F.col(f"v_{p}n").alias("v"),
                F.array(*own).alias("harmonics"),
            )
        )
    return wide.select("meter_id", "x", F.inline(F.array(*rows)))


def phase_consistency(phases: DataFrame) -> DataFrame:
    """Shares of readings that break a physical identity, per meter and phase."""
    r = AUDIT
    p, q, s, v = (F.col(c) for c in ("p", "q", "s", "v"))
    tri_ok = p.isNotNull() & q.isNotNull() & s.isNotNull() & (s != 0)
    tri = F.when(tri_ok, (p * p + q * q - s * s) / F.nullif(s * s, F.lit(0.0)))
    rows = phases.withColumn("tri", tri)
    mode = ranks.modal_value(rows, ["meter_id", "phase"], "v")
    floor = mode.select("meter_id", "phase", F.when(aggregate.is_floor(), F.col("mode_value")).alias("_floor"))
    real_v = v.isNotNull() & (v != 0) & (F.col("_floor").isNull() | (v != F.col("_floor")))
    thd_known = F.col("thdi").isNotNull() | F.col("thdv").isNotNull()
    thd_bad = F.coalesce(F.col("thdi") < 0, F.lit(False)) | F.coalesce(F.col("thdv") < 0, F.lit(False))
    h_known = F.exists("harmonics", lambda h: h.isNotNull())
    h_bad = F.exists("harmonics", lambda h: F.coalesce((h < 0) | (h > 100), F.lit(False)))
    g = rows.join(floor, ["meter_id", "phase"]).groupBy("meter_id", "phase").agg(
        share(F.abs("tri") > r.triangle_tol, F.col("tri").isNotNull()).alias("tri_viol"),
        share(p < 0, p.isNotNull() & (p != 0)).alias("reverse"),
        share(F.abs("cos") > 1.0, F.col("cos").isNotNull()).alias("cos_oob"),
        share(thd_bad, thd_known).alias("thd_neg"),
        share(h_bad, h_known).alias("harm_oob"),
        share((v < r.volt_min) | (v > r.volt_max), real_v).alias("v_oob"),
    )
    gates = [F.coalesce(F.col(c) > r.violation_share, F.lit(False)) for c in ("tri_viol", "cos_oob", "thd_neg", "harm_oob", "v_oob")]
    bad = gates[0]
    for c in gates[1:]:
        bad = bad | c
    med = ranks.quantiles(rows, ["meter_id", "phase"], "tri", {"tri_median": 0.5}).drop("n")
    return g.join(med, ["meter_id", "phase"], "left").withColumn("verdict", F.when(bad, "NON_PHYSICAL").otherwise("PHYSICAL"))


def real_rows(long: DataFrame) -> DataFrame:
    """Known cells with the flag ``real``: neither zero nor the placeholder value of the channel."""
    known = long.filter(F.col("value").isNotNull())
    mode = ranks.modal_value(known, CH, "value")
    floor = mode.select(*CH, F.when(aggregate.is_floor(), F.col("mode_value")).alias("floor_value"))
    real = (F.col("value") != 0) & (F.col("floor_value").isNull() | (F.col("value") != F.col("floor_value")))
    return known.join(floor, CH).withColumn("real", real)


def liveness(rows: DataFrame, block: int) -> DataFrame:
    """Counts of real cells and the dead-or-stuck verdict per channel."""
    r = AUDIT
    base = rows.groupBy(*CH).agg(
        F.count("*").alias("n_rows"), F.count_if("real").alias("n_real"),
        F.count_distinct(F.when(F.col("real"), F.col("value"))).alias("n_unique"),
    )
    run = aggregate.longest_equal_run(rows.filter("real"), CH, "value", block=block)
    out = base.join(run, CH, "left").withColumn("live_frac", F.col("n_real") / F.col("n_rows"))
    dead = (
        (F.col("n_real") < r.min_points) | (F.col("live_frac") < r.live_min) | (F.col("n_unique") <= 2)
        | (F.col("longest") / F.col("n_real") > r.stuck_share)
    )
    return out.withColumn("dead", F.coalesce(dead, F.lit(True)))


def active_power(rows: DataFrame, live: DataFrame, step_hours: float, limits: DataFrame | None = None, per_kw: float = 1000.0) -> DataFrame:
    """Energy, reverse flow and plausibility of the active power channels.

    ``limits(meter_id, phase, p_lim)`` in kW is optional; without it the scale stays unknown.
    """
    r = AUDIT
    x = F.when(F.col("real"), F.col("value"))
    p = rows.filter(F.col("variable").startswith("p_"))
    kwh = step_hours / per_kw
    g = p.groupBy(*CH).agg(
        (F.sum(x) * kwh).alias("signed_kwh"), (F.sum(F.abs(x)) * kwh).alias("abs_kwh"),
        share(F.col("value") < 0, F.col("real")).alias("rev_frac"),
        ratio(F.sum(F.when(x < 0, F.abs(x)).otherwise(F.when(x.isNotNull(), F.lit(0.0)))), F.sum(F.abs(x))).alias("rev_energy_frac"),
    )
    p95 = ranks.quantiles(p.filter("real").withColumn("_a", F.abs("value")), CH, "_a", {"p95_abs": 0.95}).drop("n")
    out = g.join(p95, CH, "left").join(live, CH).withColumn("phase", F.upper(names.phase_of("variable")))
    rev = F.col("rev_frac")
    sign = (
        F.when(rev.isNull(), "UNKNOWN").when(rev < r.reverse_normal, "NORMAL")
        .when(rev <= r.reverse_mixed, "MIXED").otherwise("REVERSED_OR_BIDIRECTIONAL")
    )
    if limits is None:
        out = out.withColumn("p_lim", F.lit(None).cast("double"))
    else:
        out = out.join(limits, ["meter_id", "phase"], "left")
    lim = F.col("p_lim") * r.limit_factor
    fits = (F.col("p95_abs") <= lim * per_kw) & (F.col("abs_kwh") <= lim * F.col("n_real") * step_hours)
    status = (
        F.when(F.col("dead"), "DEAD_OR_STUCK").when(F.col("n_unique") > r.min_unique, "ACTIVE_POWER_VALID")
        .otherwise("PHYSICAL_ALERT")
    )
    return out.select(
        *CH, "phase", "signed_kwh", "abs_kwh", "rev_frac", "rev_energy_frac", "p95_abs", sign.alias("sign_class"),
        F.when(F.col("p_lim").isNull() | (F.col("n_real") == 0), "WARN").when(fits, "PASS").otherwise("FAIL_EXTERNAL_REF").alias("plausibility"),
        status.alias("status"),
    )


def power_reference(wide: DataFrame, power: DataFrame) -> DataFrame:
    """Valid phase powers per reading (NULL where the phase is not valid) and their sum."""
    valid = power.groupBy("meter_id").agg(
        *[F.max(F.when(F.col("variable") == f"p_{p}", F.col("status") == "ACTIVE_POWER_VALID")).alias(f"ok_{p}") for p in PHASES]
    )
    ref = [F.when(F.col(f"ok_{p}"), F.col(f"p_{p}")).alias(f"ref_{p}") for p in PHASES]
    out = wide.join(valid, "meter_id").select("meter_id", "x", *ref, *[f"ok_{p}" for p in PHASES])
    total = sum((F.coalesce(f"ref_{p}", F.lit(0.0)) for p in PHASES), F.lit(0.0))
    anyone = F.col("ok_a") | F.col("ok_b") | F.col("ok_c")
    return out.withColumn("ref_total", F.when(anyone, total))


def own_physics(family: Column, x: Column, p: Column, s: Column) -> Column:
    """True where a value breaks the rule of its own family."""
    r = AUDIT
    tol = r.violation_share
    return (
        F.when(family == "v", (x < r.volt_min) | (x > r.volt_max))
        .when(family.isin("i", "thdi", "thdv"), x < 0)
        .when(family == "cos", F.abs(x) > 1.0)
        .when(family == "s", (x < 0) | F.coalesce(x < F.abs(p) * (1 - tol), F.lit(False)))
        .when(family == "q", F.coalesce(F.abs(x) > s * (1 + tol), F.lit(False)))
        .when(family.isin("hrm_i", "hrm_v"), (x < 0) | (x > 100))
        .otherwise(F.lit(False))
    )


def classify(dead: Column, own_ok: Column, r2: Column, n_unique: Column) -> Column:
    r = AUDIT
    return (
        F.when(dead, "DEAD_OR_STUCK").when(n_unique <= r.min_unique, "EXCLUDE")
        .when(F.coalesce(r2 >= r.redundant_r2, F.lit(False)), "REDUNDANT_WITH_POWER")
        .when(own_ok, "PHYSICAL_VALID").otherwise("PHYSICAL_ALERT")
    )


def spread_powers(wide: DataFrame) -> DataFrame:
    """Add ``_e_b`` and ``_e_c``: what the powers of phases b and c say beyond the phases before them.

    The three powers of a meter move almost alike. Regressing on these remainders explains exactly as much,
    without the cancellation that sums of products of near copies suffer.
    """
    line = lambda y, x, n: [F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias(f"_{n}1"), F.coalesce(F.regr_intercept(y, x), F.lit(0.0)).alias(f"_{n}0")]
    first = wide.groupBy("meter_id").agg(*line("p_b", "p_a", "b"), *line("p_c", "p_a", "c"))
    rest = lambda p, n: F.col(p) - (F.col(f"_{n}0") + F.col(f"_{n}1") * F.col("p_a"))
    out = wide.join(first, "meter_id").withColumn("_e_b", rest("p_b", "b")).withColumn("_u", rest("p_c", "c"))
    second = out.groupBy("meter_id").agg(F.coalesce(F.regr_slope("_u", "_e_b"), F.lit(0.0)).alias("_k"))
    out = out.join(second, "meter_id").withColumn("_e_c", F.col("_u") - F.col("_k") * F.col("_e_b"))
    return out.drop("_b0", "_b1", "_c0", "_c1", "_u", "_k")


def channel_audit(wide: DataFrame, variables: Sequence[str], step_hours: float, block: int) -> DataFrame:
    """Class of every channel from liveness, own physics and redundancy with the valid powers."""
    side = [f"{q}_{p}" for q in ("p", "s") for p in PHASES]
    kept = spread_powers(wide).select("meter_id", "x", "_e_b", "_e_c", *variables, *[F.col(c).alias(f"_{c}") for c in side])
    long = kept.unpivot(["meter_id", "x", "_e_b", "_e_c", *[f"_{c}" for c in side]], list(variables), "variable", "value")
    rows = stage(real_rows(long))  # read by the four passes below
    live = stage(liveness(rows.select(*CH, "x", "value", "real"), block))  # one row per channel
    power = stage(active_power(rows, live, step_hours))
    status = power.select("meter_id", "variable", F.col("status").alias("p_status"))
    ok = power.groupBy("meter_id").agg(
        *[F.max(F.when(F.col("variable") == f"p_{p}", F.col("status") == "ACTIVE_POWER_VALID")).alias(f"ok_{p}") for p in PHASES]
    )
    phase, fam = names.phase_of("variable"), names.family_of("variable")
    pick = lambda q: F.when(phase == "a", F.col(f"_{q}_a")).when(phase == "b", F.col(f"_{q}_b")).when(phase == "c", F.col(f"_{q}_c"))
    rows = rows.join(ok, "meter_id").filter("real")
    anyone = F.col("ok_a") | F.col("ok_b") | F.col("ok_c")
    every = F.col("ok_a") & F.col("ok_b") & F.col("ok_c")
    spread = {"a": F.col("_p_a"), "b": F.col("_e_b"), "c": F.col("_e_c")}
    xs = [
        F.when(~anyone, F.lit(None).cast("double")).when(every, spread[p]).when(F.col(f"ok_{p}"), F.col(f"_p_{p}")).otherwise(F.lit(0.0))
        for p in PHASES
    ]
    s_ph = pick("s")
    g = rows.groupBy(*CH).agg(
        F.avg(F.coalesce(own_physics(fam, F.col("value"), pick("p"), s_ph), F.lit(False)).cast("int")).alias("viol"),
        F.signum(safe_corr("value", s_ph)).alias("_sg"),
        F.regr_r2(F.col("value"), F.col("x")).alias("r2_clock"),
        *[c.alias(f"_{n}") for n, c in aggregate.gram(F.col("value"), xs)],
    )
    g = aggregate.solve_r2(g, len(xs)).select(*CH, "viol", "_sg", "r2_clock", F.col("r2").alias("r2_power"))
    stats = ranks.median_mad(rows.select(*CH, "value"), CH, "value").select(*CH, "median", "mad")
    out = live.join(g, CH, "left").join(stats, CH, "left").join(status, CH, "left")
    own_ok = F.coalesce(F.col("viol") <= AUDIT.violation_share, F.lit(False))
    cls = F.when(F.col("p_status").isNotNull(), F.col("p_status")).otherwise(
        classify(F.col("dead"), own_ok, F.col("r2_power"), F.col("n_unique"))
    )
    is_p = F.col("p_status").isNotNull()
    return out.select(
        *CH, names.long_family("variable").alias("family"), F.upper(phase).alias("phase"), "n_real", "live_frac", "n_unique", "longest",
        "dead", "median", "mad", F.when(~is_p, F.col("r2_power")).alias("r2_power"), F.when(~is_p, F.col("r2_clock")).alias("r2_clock"),
        F.when(is_p, F.lit(0)).otherwise(F.coalesce("_sg", F.lit(0.0))).cast("int").alias("sign_s"),
        F.when(~is_p, own_ok).alias("own_ok"),
        F.coalesce(~is_p & (F.col("r2_power") >= AUDIT.strong_r2), F.lit(False)).alias("redundant_strong"),
        cls.alias("channel_class"),
    )


def energy_coherence(power: DataFrame, main: Sequence[int], loads: Sequence[int]) -> DataFrame:
    """Main energy against the sum of the loads, per phase; a warning, never an exclusion."""
    r = AUDIT.coherence_ratio
    e = lambda ids: F.coalesce(F.sum(F.when(F.col("meter_id").isin(list(ids)), F.col("signed_kwh"))), F.lit(0.0))
    g = power.groupBy("phase").agg(e(main).alias("e_main"), e(loads).alias("e_loads"))
    g = g.withColumn("ratio", F.abs("e_main") / (F.abs("e_loads") + 1e-9))
    ok = F.col("ratio").between(1.0 / r, r)
    return g.withColumn("delta", F.col("e_loads") - F.col("e_main")).withColumn("status", F.when(ok, "OK").otherwise("WARN"))


def eligibility(audit: DataFrame) -> DataFrame:
    """Channels and share per class, with flag totals."""
    return aggregate.class_counts(audit, "channel_class", {"n_strong": F.col("redundant_strong"), "n_dead": F.col("dead")})
