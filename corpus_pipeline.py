"""From raw documents to token ids: quality, near copies, repeated passages, benchmark leaks, BPE.

Every stage takes ``documents`` (extra columns stay) and returns them, but for the last, which returns the ids. Null or empty texts are
judged like any other; a row without ``doc_id`` is nobody's copy; empty tables pass through; repeated rows are judged alike. No stage but
the first is asked to drop a document for what it lost: one whose passages were all said before stays, with what is left of its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import bpe, fmindex, leaks, quality, simhash
from voltloom.llm.frame import ready, table
from voltloom.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    ready(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component, over five-word shingles of similarity 0.8 or more."""
    ready(spark)
    return simhash.one_of_each(docs, size=5, similarity=0.8)


def said_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word passages that occur earlier; ``n_chars`` follows."""
    ready(spark)
    cut = fmindex.shortened(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ready(spark)
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and digests of the ids and of what they decode to."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.round_trip(docs, path)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_quality),
    ("near copies", one_of_near_copies),
    ("repeated passages", said_once),
    ("benchmark leaks", without_benchmark),
    ("token ids", token_ids),
]

#: SQL cannot express the classifier, the hashes and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
