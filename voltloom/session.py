"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows a byte of Parquet stands for. Channel names and steps repeat and are stored in next to nothing, and a scan of the wide table
#: becomes a row a quantity: files of 10 MB made broadcasts of 1 GB.
UNPACKED = 100


def prepare(spark: SparkSession, unpacked: int = 1) -> SparkSession:
    """Pin the settings results depend on, and the bytes of rows in a byte of files by which joins are planned; sizing stays with the cluster.

    A table too large for a broadcast by this measure is shuffled, and broadcast after all if its shuffled rows prove few.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(unpacked)))
    return spark


def build_session(cores: str = "8", app: str = "voltloom") -> SparkSession:
    """Local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and stage tables: ``spark.checkpoint.dir``, or a scratch folder in local tests."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the rounds of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table several steps read and continue from the written one.

    Later plans start at a columnar scan with known size, and a lost executor costs a read, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
