"""Small helpers the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.session import prepare

#: Rows of one Arrow batch: a few MB of text, so that a Python worker stays small whatever a partition holds.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns never meet the names an operator makes. A null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def per_batch(df: DataFrame, ddl: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """One batch in, one batch out."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch), schema=schema)

    return df.mapInArrow(run, ddl)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column in a row, and the border of each text (one more than texts)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers: two rounds of shift and multiplication."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, whole, for which ``keep`` says so; it gets ``doc_id`` and ``text`` as ``texts`` gives them."""
    together = df.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(keep(batch)))], ["row"])

    return together.mapInArrow(run, together.select("row").schema).select("row.*")
