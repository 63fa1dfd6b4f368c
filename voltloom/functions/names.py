"""What a quantity name says: family, phase, side, additivity, triplet."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name patterns of the four column groups
PRIMARY = r"^[iv]_[abc]n$"
SECONDARY = r"^(p|q|s|cos)_[abc]$"
DISTORTION = r"^thd[iv]_[abc]$"
HARMONIC = r"^hrm_[iv]_[abc]n_[0-9]+$"
PHASE = r"^(?:hrm_[iv]|thd[iv]|cos|[ivpqs])_([abc])n?(?:_[0-9]+)?$"
FAMILY = r"^(hrm_[iv]|thd[iv]|cos|[ivpqs])_"
ORDER = r"^hrm_[iv]_[abc]n_([0-9]+)$"


def column_group(name: str) -> str:
    for pattern, group in ((PRIMARY, "primary"), (SECONDARY, "secondary"), (HARMONIC, "harmonic")):
        if re.match(pattern, name):
            return group
    return "distortion"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phase_of(c: str | Column) -> Column:
    """``a``, ``b``, ``c`` or the empty text."""
    return F.regexp_extract(_c(c), PHASE, 1)


def family_of(c: str | Column) -> Column:
    """Short family: i, v, p, q, s, cos, thdi, thdv, hrm_i, hrm_v, or meta."""
    short = F.regexp_extract(_c(c), FAMILY, 1)
    return F.when(short == "", F.lit("meta")).otherwise(short)


def long_family(c: str | Column) -> Column:
    """Family names of the audit: voltage and current are spelled out."""
    short = family_of(c)
    return F.when(short == "v", "voltage").when(short == "i", "current").otherwise(short)


def is_voltage(c: str | Column) -> Column:
    return family_of(c).isin("v", "thdv", "hrm_v")


def is_energy_side(c: str | Column) -> Column:
    return family_of(c).isin("i", "p", "q", "s", "cos", "thdi", "hrm_i")


def is_harmonic(c: str | Column) -> Column:
    return family_of(c).isin("thdi", "thdv", "hrm_i", "hrm_v")


def is_additive(c: str | Column) -> Column:
    """Quantities that add up over parallel circuits; all others are averaged."""
    return family_of(c).isin("i", "p", "q", "s", "hrm_i")


def triplet_of(c: str | Column) -> Column:
    """Key shared by the three phases of an energy-side quantity; NULL for voltage."""
    fam = family_of(c)
    order = F.regexp_extract(_c(c), ORDER, 1)
    name = F.when(fam == "i", "i_n").when(fam == "hrm_i", F.concat(F.lit("hrm_i_"), order)).otherwise(fam)
    return F.when(fam.isin("i", "p", "q", "s", "cos", "thdi", "hrm_i"), name)


def describe(df, c: str = "variable"):
    """Add the name columns to a long table."""
    return (
        df.withColumn("family", family_of(c))
        .withColumn("phase", phase_of(c))
        .withColumn("side", F.when(is_voltage(c), "voltage").when(is_energy_side(c), "energy").otherwise("meta"))
        .withColumn("additive", is_additive(c))
        .withColumn("triplet", triplet_of(c))
    )


def parse_flag(c: str | Column) -> Column:
    """True for the accepted spellings of yes."""
    # fixed values: spellings of a true flag
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("true", "1", "1.0", "yes", "sim"), F.lit(False))
