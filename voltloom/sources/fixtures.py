"""Meter tables derived from the given ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions.numeric import fixed, missing_to_null
from voltloom.operators import grid, seq

PHASES = ("a", "b", "c")
T0 = "2024-01-01 00:00:00"
STEP = 3600
BLOCK = 168  # one week of hours
FLOOR = 0.196197

# fixed values: families of the fixture, three phases each
FAMILY_PATTERNS = (
    "v_{p}n", "i_{p}n", "s_{p}", "cos_{p}", "p_{p}", "q_{p}",
    "thdi_{p}", "thdv_{p}", "hrm_i_{p}n_3", "hrm_v_{p}n_5",
)
VARIABLES = tuple(f.format(p=p) for f in FAMILY_PATTERNS for p in PHASES)

# fixed values: role of each meter
METERS = (
    (1, "MAIN", "m_g_input", None),
    (2, "REVERSE", "excluded", None),
    (3, "LOAD3", "modeled_loads", 1),
    (4, "COMP4", "p_other_components", None),
    (5, "LOAD5", "modeled_loads", 2),
    (6, "LOAD6", "modeled_loads", 3),
    (7, "LOAD7", "modeled_loads", 4),
    (8, "DEAD8", "dead_redundant", None),
)

# fixed values: prediction models with window length, family, shift, and lean (a share by load and phase)
MODEL_ROWS = (
    ("m12", 12, "primary", 0.0, 0.0),
    ("m18", 18, "primary", -0.005, 0.004),
    ("m24", 24, "primary", 0.0025, -0.006),
    ("m30", 30, "primary", 0.005, 0.008),
    ("m36", 36, "primary", 0.01, 0.0),
    ("m48", 48, "primary", 0.0075, 0.01),
    ("m24t", 24, "sensitivity", 0.0075, -0.003),
    ("m36t", 36, "sensitivity", 0.0025, 0.005),
)
MODELS = tuple((m, w) for m, w, *_ in MODEL_ROWS)
PRIMARY = tuple(m for m, _, family, *_ in MODEL_ROWS if family == "primary")

# fixed values: epochs of the training histories
EPOCHS = 12
SEEDS = (1, 2, 3, 4, 5)

# fixed values: component meters of the remaining consumption
COMPONENTS = (2, 4)


def raw_readings(events: DataFrame) -> DataFrame:
    """Readings with every injected defect, NaN cells and repeated rows included."""
    k = F.get_json_object("props", "$.k").cast("int")
    volt = {"a": 210, "b": 212, "c": 214}
    amp = {"a": 10.0, "b": 12.0, "c": 15.0}
    e = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("time"),
        (F.col("user_id") % 8 + 1).cast("int").alias("meter_id"),
        "event_type",
        "value",
        k.alias("k"),
    )
    # meter 7 repeats meter 6; its own rows are left out
    e = e.filter("meter_id <> 7").withColumn(
        "meter_id",
        F.explode(F.when(F.col("meter_id") == 6, F.array(F.lit(6), F.lit(7))).otherwise(F.array("meter_id"))),
    )
    day = F.dayofmonth("time")
    e = e.filter(~((F.col("meter_id") == 5) & day.between(20, 22)))
    floor = ((F.col("meter_id") == 4) & day.between(10, 14)) | (F.col("meter_id") == 8)
    cos = F.lit(0.70) + (F.col("event_id") % 25) / F.lit(100.0)
    cols: dict[str, Column] = {}
    for p in PHASES:
        v = F.lit(float(volt[p])) + F.col("k") / F.lit(10.0)
        i = F.col("value") / F.lit(amp[p])
        s = v * i
        act = s * cos
        act = F.when((F.col("event_type") == "error") & (F.col("meter_id") == 2), -act).otherwise(act)
        rea = s * F.sqrt(F.lit(1.0) - cos * cos)
        rea = F.when(F.col("meter_id") == 3, rea * F.lit(1.5)).otherwise(rea)
        if p == "a":
            act = F.when(F.col("event_id") % 397 == 0, act * F.lit(50.0)).otherwise(act)
        cols[f"v_{p}n"] = F.when(F.col("event_id") % 53 == 0, F.lit(None)).otherwise(v) if p == "b" else v
        cols[f"i_{p}n"] = F.when(floor, F.lit(FLOOR)).otherwise(i)
        cols[f"s_{p}"] = F.when(floor, F.lit(FLOOR)).otherwise(s)
        cols[f"cos_{p}"] = cos
        cols[f"p_{p}"] = F.when(floor, F.lit(FLOOR)).otherwise(act)
        q = F.when(floor, F.lit(FLOOR)).otherwise(rea)
        if p == "c":
            q = F.when(F.col("event_id") % 59 == 0, F.lit(float("nan"))).otherwise(q)
        cols[f"q_{p}"] = q
        cols[f"thdi_{p}"] = F.col("k") / F.lit(10.0)
        cols[f"thdv_{p}"] = F.col("k") / F.lit(20.0)
        cols[f"hrm_i_{p}n_3"] = F.col("k") * F.lit(1.02)
        cols[f"hrm_v_{p}n_5"] = F.col("k") / F.lit(25.0)
    copies = F.when(F.col("event_id") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        e.withColumn("_copy", F.explode(copies))
        .select("meter_id", "time", "k", *[c.cast("double").alias(n) for n, c in cols.items()])
        .select("meter_id", "time", "k", *VARIABLES)
    )


def cleaned(raw: DataFrame) -> DataFrame:
    """Readings with NULL as the only missing value."""
    return raw.select("meter_id", "time", "k", *[missing_to_null(v).alias(v) for v in VARIABLES])


def readings(raw: DataFrame) -> DataFrame:
    """Distinct cleaned readings."""
    return cleaned(raw).dropDuplicates()


def gridded(rows: DataFrame) -> DataFrame:
    """Hourly means (missing cells count as zero), rounded so that both engines hold equal values."""
    means = grid.grid_mean(rows, ["meter_id"], VARIABLES, T0, STEP, null_as_zero=True)
    return means.select("meter_id", "x", *[fixed(v).alias(v) for v in VARIABLES])


def dense(wide: DataFrame) -> DataFrame:
    return grid.densify(wide, ["meter_id"])


def samples(wide: DataFrame) -> DataFrame:
    return grid.to_long(wide, ["meter_id", "x"], VARIABLES)


def meter_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METERS, "meter_id int, label string, role string, gamma_id int")


def truth(long: DataFrame, dim: DataFrame) -> DataFrame:
    """Targets ``(output, gamma, phase, x, y)``: active power of the modelled loads."""
    loads = dim.filter("role = 'modeled_loads'").select("meter_id", "gamma_id")
    phase = F.upper(F.substring("variable", 3, 1))
    return (
        long.filter(F.col("variable").isin("p_a", "p_b", "p_c"))
        .join(loads, "meter_id")
        .select(
            F.concat(F.lit("G"), F.col("gamma_id"), F.lit("_"), phase).alias("output"),
            F.col("gamma_id").alias("gamma"),
            phase.alias("phase"),
            "meter_id",
            "variable",
            "x",
            F.coalesce("value", F.lit(0.0)).alias("y"),
        )
    )


def predictions(target: DataFrame, steps: int) -> DataFrame:
    """Predictions ``(model, seed, window_idx, output, y_pred)`` around the truth of ``steps`` grid steps."""
    fields = ("model", "w", "family", "shift", "lean")
    models = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row)]) for row in MODEL_ROWS])
    seeds = F.array(*[F.lit(s) for s in SEEDS])
    wobble = F.lit(1.0) + (((F.col("x") * F.col("seed") + F.col("gamma")) % 7) - 3) / F.lit(100.0)
    grown = (
        target.withColumn("_m", F.explode(models))
        .withColumn("seed", F.explode(seeds))
        .select("*", "_m.*")
        .withColumn("window_idx", F.col("x") - (F.col("w") / 2).cast("long"))
        .filter((F.col("window_idx") >= 0) & (F.col("window_idx") <= F.lit(steps) - F.col("w")))
    )
    side = (F.col("gamma") * F.col("w") / 6 + F.ascii("phase")).cast("long") % 5 - 2
    factor = wobble + F.col("shift") + F.col("lean") * side
    return grown.select("model", "seed", "window_idx", "output", (F.col("y") * factor).alias("y_pred"))


def history(scored: DataFrame, train_end: int, valid_end: int) -> DataFrame:
    """Training history ``(model, seed, epoch, loss, val_loss)``: mean squared errors of predictions that approach the final ones."""
    square = (F.col("y_pred") - F.col("y")) * (F.col("y_pred") - F.col("y"))
    x = F.col("x")
    last = scored.groupBy("model", "seed").agg(
        F.avg(F.when(x < train_end, square)).alias("_train"),
        F.avg(F.when((x >= train_end) & (x < valid_end), square)).alias("_valid"),
    )
    far = F.pow(1.0 + 4.0 / F.col("epoch"), F.lit(2.0))
    grown = last.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    return grown.select("model", "seed", "epoch", (F.col("_train") * far).alias("loss"), (F.col("_valid") * far).alias("val_loss"))


def confidence(long: DataFrame) -> DataFrame:
    """Code per cell: 0 observed, 1 gap of at most 2 steps, 2 gap of 3..24, 3 longer."""
    keys = ["meter_id", "variable"]
    gaps = seq.runs(long, keys, F.col("value").isNull(), block=BLOCK)
    code = F.when(F.col("n") <= 2, 1).when(F.col("n") <= 24, 2).otherwise(3)
    filled = seq.interval_points(gaps.withColumn("code", code), keys, "code")
    observed = long.filter("value is not null").select(*keys, "x", F.lit(0).alias("code"))
    return observed.unionByName(filled)


def component_power(wide: DataFrame, meters: tuple[int, ...]) -> DataFrame:
    """``(meter_id, phase, x, p)`` of some meters, missing power counted as zero."""
    long = wide.filter(F.col("meter_id").isin(list(meters))).unpivot(
        ["meter_id", "x"], ["p_a", "p_b", "p_c"], "variable", "p"
    )
    return long.select(
        "meter_id", F.upper(F.substring("variable", 3, 1)).alias("phase"), "x", F.coalesce("p", F.lit(0.0)).alias("p")
    )


def phase_power(wide: DataFrame, meters: tuple[int, ...], name: str) -> DataFrame:
    return component_power(wide, meters).groupBy("phase", "x").agg(F.sum("p").alias(name))
