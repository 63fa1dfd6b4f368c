"""Readers and writers of meter tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.functions import names


def parse_time(c: str | Column) -> Column:
    """Timestamp of a text; NULL where it does not parse."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def read_readings(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """CSV readings with a fixed schema: text stamps are coerced, NaN cells become NULL."""
    schema = T.StructType(
        [T.StructField("time", T.StringType()), T.StructField("meter_id", T.IntegerType())]
        + [T.StructField(v, T.DoubleType()) for v in variables]
    )
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    cells = [F.when(F.isnan(v), F.lit(None)).otherwise(F.col(v)).alias(v) for v in variables]
    return rows.select(parse_time("time").alias("time"), "meter_id", *cells)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix. A CSV with a given schema is read once; without, its columns are text."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    return spark.read.parquet(path)


def write_standardized(df: DataFrame, path: str, time: str = "time") -> None:
    """Columnar copy, one folder per day."""
    df.withColumn("date", F.to_date(time)).write.mode("overwrite").partitionBy("date").parquet(path)


def write_windows(windows: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def split_by_family(df: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """One projection per column group; the key stays in every slice, other columns join the distortion slice."""
    groups: dict[str, list[str]] = {"primary": [], "secondary": [], "distortion": [], "harmonic": []}
    for c in df.columns:
        if c not in keys:
            groups[names.column_group(c)].append(c)
    return {g: df.select(*keys, *cols) for g, cols in groups.items()}


def read_predictions(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Union of one prediction table per model; a missing file is an error, never a shorter table."""
    out = None
    for model, path in files.items():
        part = spark.read.parquet(path).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no prediction table named")
    return out


def require_models(predictions: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The models expected but absent; ``raise_if_any`` turns a row into an error."""
    want = predictions.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    return want.join(predictions.select("model").distinct(), "model", "left_anti")


def raise_if_any(rows: DataFrame, message: str) -> None:
    first = rows.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def write_feature_sets(sets: DataFrame, path: str) -> None:
    """``(set, rank, feature)`` rows."""
    sets.select("set", "rank", "feature").write.mode("overwrite").parquet(path)


def read_feature_set(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("set") == name).orderBy("rank")


def table_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and column names of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_cols"),
            F.lit(",".join(sorted(df.columns))).alias("columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out
