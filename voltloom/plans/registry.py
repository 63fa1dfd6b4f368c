"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.operators import balance, evaluate, joins, seq
from voltloom.session import UNPACKED, prepare, stage
from voltloom.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


class Inputs:
    """Lazy access to the tables of one folder and to the series derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result several queries share, written once per application."""
        if name not in self._kept:
            self._kept[name] = stage(build())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return fixtures.raw_readings(self.table("events"))

    @cached_property
    def readings(self) -> DataFrame:
        return fixtures.readings(self.raw)

    @cached_property
    def gridded(self) -> DataFrame:
        return fixtures.gridded(self.readings)

    @cached_property
    def dense(self) -> DataFrame:
        """The common grid, shared by nearly every query and therefore written once per application."""
        return stage(fixtures.dense(self.gridded))

    @cached_property
    def steps(self) -> int:
        """Grid steps from the origin to the last reading."""
        return self.dense.agg(F.max("x")).first()[0] + 1

    @property
    def train_end(self) -> int:
        """Chronological split: the first eight tenths of the steps train, the next tenth validates, the last tests."""
        return self.steps * 8 // 10

    @property
    def valid_end(self) -> int:
        return self.steps * 9 // 10

    def split(self) -> Column:
        return F.when(F.col("x") < self.train_end, "train").when(F.col("x") < self.valid_end, "val").otherwise("test")

    @cached_property
    def samples(self) -> DataFrame:
        return fixtures.samples(self.dense)

    @cached_property
    def meter_dim(self) -> DataFrame:
        return fixtures.meter_dim(self.spark)

    @cached_property
    def truth(self) -> DataFrame:
        return fixtures.truth(self.samples, self.meter_dim)

    @cached_property
    def predictions(self) -> DataFrame:
        return fixtures.predictions(self.truth, self.steps)

    @cached_property
    def gaps(self) -> DataFrame:
        keys = ["meter_id", "variable"]
        missing = F.col("value").isNull()
        return self.kept("gaps", lambda: seq.runs(self.samples, keys, missing, block=fixtures.BLOCK))

    @cached_property
    def conf(self) -> DataFrame:
        return self.kept("conf", lambda: fixtures.confidence(self.samples))

    @cached_property
    def scored(self) -> DataFrame:
        """Predictions beside the truth, shared by the scores, balances and tests."""
        aligned = joins.align_windows(self.predictions, dict(fixtures.MODELS))
        return stage(evaluate.score_rows(aligned, self.truth))

    @cached_property
    def history(self) -> DataFrame:
        return fixtures.history(self.scored, self.train_end, self.valid_end)

    @cached_property
    def load_metrics(self) -> DataFrame:
        return self.kept("load_metrics", lambda: evaluate.load_metrics(self.scored, 1.0))

    @cached_property
    def rest(self) -> DataFrame:
        """Remaining consumption: power of the component meters per phase and instant."""
        return fixtures.phase_power(self.dense, fixtures.COMPONENTS, "po")

    @cached_property
    def main(self) -> DataFrame:
        return fixtures.phase_power(self.dense, (1,), "mg_real")

    @cached_property
    def balance(self) -> DataFrame:
        return self.kept("balance", lambda: balance.series(self.scored, self.rest, self.main))


_OPEN: dict[tuple, Inputs] = {}


def files_of(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file of the folder, from the file system that Spark reads it with."""
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = top.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """The derived tables of a folder, planned once per application and state of its files."""
    key = (spark.sparkContext.applicationId, folder, files_of(spark, folder))
    prepare(spark, UNPACKED)
    if key not in _OPEN:
        _OPEN[key] = Inputs(spark, folder)
    return _OPEN[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(Inputs) -> DataFrame`` under a name, with its SQL twin if there is one."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = lambda spark, folder: fn(inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
