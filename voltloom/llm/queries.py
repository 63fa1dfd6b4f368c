"""One query for each operator, with its parameters in production."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import anchors, bpe, exchange, fmindex, hosts, leaks, linecrf, manifest, negatives, oracles, quality, repair, simhash, suffix, toxicity
from voltloom.llm.frame import table
from voltloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = {
    "op3_fm_index": oracles.REPEATED_WORDS, "op6_suffix_array": oracles.REPEATED_BYTES, "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_merkle_manifest": oracles.MERKLE, "op13_exact_exchange": oracles.EXACT,
}

END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID, path)
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linecrf.judge(docs, linecrf.fit(docs, table(spark, sf_dir, "labels"))).drop("labels")


@query
def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fmindex.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op9_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), RULES).drop("words")


@query
def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.when(F.col("doc_id") != anchors.NO_ID, F.col("doc_id")).alias("doc_id"), "item_id", "edits", "word_end", "item_words").distinct()


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.known(table(spark, sf_dir, "embeddings"), label))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.without_newlines())


@query
def op13_exact_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.exact_duplicates(table(spark, sf_dir, "documents"))
