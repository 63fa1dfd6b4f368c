"""Decision tables that people and earlier steps leave as text: scope, dead channels, gap rule.

Columns may have older names, stamps of truth may be words, and a channel may be named by phase, by variable or by a label such as ``M05-A``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words that mean yes, older column names, power columns
YES = ("true", "1", "yes", "sim")
VARIABLE_NAMES = ("variavel", "variable", "var", "column")
PORTION_NAMES = ("n_porcoes_onda", "n_porcoes", "portions")
POWERS = {"p_a": "a", "p_b": "b", "p_c": "c"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column as text; the parsers decide the types."""
    return spark.read.option("header", True).csv(path)


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; found {df.columns}")


def text(name: str) -> Column:
    return F.lower(F.trim(F.col(name).cast("string")))


def scope_decision(table: DataFrame) -> DataFrame:
    """``meter_id, process`` of a scope table."""
    require(table, ["meter_id", "process_in_next_script"])
    return table.select(F.col("meter_id").cast("double").cast("int").alias("meter_id"), F.coalesce(text("process_in_next_script").isin(*YES), F.lit(False)).alias("process"))


def dead_power_channels(table: DataFrame) -> DataFrame:
    """Distinct ``meter_id, phase`` of the power channels that a table of dead channels names.

    The phase comes from ``phase``, else from a variable that is a power or ends like a label, else from ``channel``; rows that name none are
    left out, and so is a table without ``meter_id``.
    """
    if "meter_id" not in table.columns:
        return table.select(F.lit(None).cast("int").alias("meter_id"), F.lit(None).cast("string").alias("phase")).limit(0)
    found = [F.when(text("phase").isin(*POWERS.values()), text("phase"))] if "phase" in table.columns else []
    for name in VARIABLE_NAMES:
        if name in table.columns:
            v = text(name)
            found += [F.when(v == power, F.lit(phase)) for power, phase in POWERS.items()] + [F.nullif(F.regexp_extract(v, "[-_]([abc])$", 1), F.lit(""))]
    if "channel" in table.columns:
        found.append(F.nullif(F.regexp_extract(text("channel"), "[-_]([abc])$", 1), F.lit("")))
    phase = F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")
    rows = table.select(F.expr("try_cast(try_cast(meter_id as double) as int)").alias("meter_id"), phase.alias("phase"))
    return rows.dropna().distinct()


def dead_pairs(table: DataFrame) -> DataFrame:
    """Distinct ``meter_id, variable`` of a table of dead channels; none if it names no variables."""
    names = [n for n in VARIABLE_NAMES if n in table.columns]
    if "meter_id" not in table.columns or not names:
        return table.select(F.lit(None).cast("int").alias("meter_id"), F.lit(None).cast("string").alias("variable")).limit(0)
    variable = F.coalesce(*[F.trim(F.col(n).cast("string")) for n in names])
    return table.select(F.expr("try_cast(try_cast(meter_id as double) as int)").alias("meter_id"), variable.alias("variable")).dropna().distinct()


def gap_rule(table: DataFrame, unit: int = 1) -> list[tuple[int, int, int | None, int]]:
    """``(category, low, high, portions)`` by rising length; an empty or missing upper bound is open.

    The rule has a row for each category of gaps and is read by the driver. Lengths are divided by ``unit`` (the minutes of a grid step). Rows
    without lower bound or portions are left out; a rule without rows is an error.
    """
    require(table, ["min_min", "max_min"])
    portions = next((n for n in PORTION_NAMES if n in table.columns), None)
    if portions is None:
        raise ValueError(f"one of {PORTION_NAMES} is missing; found {table.columns}")
    number = lambda n: F.expr(f"try_cast(try_cast({n} as double) as long)").alias(n)
    rows = table.select(number("min_min"), number("max_min"), number(portions)).dropna(subset=["min_min", portions]).orderBy("min_min").collect()
    if not rows:
        raise ValueError("the gap rule has no valid row")
    return [(k, -(-r[0] // unit), None if r[1] is None else r[1] // unit, r[2]) for k, r in enumerate(rows, 1)]


def require_power_columns(df: DataFrame) -> DataFrame:
    """The table itself; an error names the power columns it lacks."""
    require(df, list(POWERS))
    return df
