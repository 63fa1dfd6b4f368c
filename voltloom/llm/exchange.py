"""Exact duplicates by an exchange of Golomb-coded fingerprints.

One pass over the texts makes a row of id, 64-bit hash and SHA-256. Senders (stretches of that small table) reduce the hashes to as many
bits as the number of rows calls for, sort them, code the gaps in Golomb-Rice form and send each owner of a hash range its part. An owner
answers with one bit for every hash it got: met more than once or not. Only texts of suspect hashes move then: they are grouped by their
bytes, copies being merged before the shuffle, so a group of any size costs one text a task.

Defined results: texts are equal when their bytes are, after A-Z became lower case; a null text counts as empty; of equal texts the row with
the largest ``doc_id`` stays (a null id is smaller than any); of rows that repeat id and text one stays; extra columns are left out.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.llm.frame import arrow_schema, texts
from voltloom.session import stage

#: Bits beyond those that number the rows: one text in a thousand is suspected wrongly, which only costs its shuffle.
SPARE = 10
#: Hashes a sender codes at once, and different ones an owner is to get.
SENT, OWNED = 1 << 18, 1 << 20
#: Suspect hashes that are sent to all tasks (8 bytes each); more meet the texts in a shuffle.
SHOWN = 2_000_000
SALTS = 32
#: Groups of more than this share of all rows meet their rows by broadcast; there are at most a thousand.
HOT = 1000


def normal(text: str | Column = "text") -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def golomb(values: np.ndarray) -> tuple[int, bytes]:
    """Rice parameter and code of ascending different numbers: all gaps in unary, then all remainders."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = int(values[-1]) // len(values)
    low = max((mean * 2 // 3).bit_length(), 0)  # about log2(mean * ln 2), rounded up
    ends = np.cumsum((gaps >> np.uint64(low)) + np.uint64(1)).astype(np.int64) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return low, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def opened(n: int, low: int, code: bytes) -> np.ndarray:
    """The numbers that ``golomb`` coded."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    tail = -(-n * low // 8) * 8
    unary, rest = bits[: len(bits) - tail], bits[len(bits) - tail :][: n * low]
    quotients = np.diff(np.flatnonzero(unary), prepend=-1).astype(np.uint64) - np.uint64(1)
    remainders = rest.reshape(n, low).astype(np.uint64) << np.arange(low, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(low)) + remainders.sum(axis=1, dtype=np.uint64), dtype=np.uint64)


SENDER = "sender long, owner int, n int, low int, code binary, twice binary"
REPLY = "sender long, owner int, met binary"


def short(fp: np.ndarray, bits: int) -> np.ndarray:
    return fp.view(np.uint64) >> np.uint64(64 - bits)


def sent(prints: DataFrame, bits: int, share: int) -> DataFrame:
    """One row for each sender and owner: the sender's different hashes in the owner's range and, as bits, which it has twice itself.

    The highest ``share`` bits of a hash are its owner.
    """
    schema = arrow_schema(SENDER)

    def packed(sender: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        owners = values >> np.uint64(bits - share)
        inner = values & np.uint64((1 << (bits - share)) - 1)
        found, at = np.unique(owners, return_index=True)
        rows: dict[str, list] = {c: [] for c in schema.names}
        for owner, a, b in zip(found.tolist(), at, [*at[1:], len(values)], strict=True):
            low, code = golomb(inner[a:b])
            for c, x in zip(schema.names, (sender, owner, b - a, low, code, np.packbits(counts[a:b] > 1).tobytes()), strict=True):
                rows[c].append(x)
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches):
        first, held, n, k = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            held.append(short(batch.column("fp").to_numpy(), bits))
            n += batch.num_rows
            if n >= SENT:
                yield packed(first + k, held)
                held, n, k = [], 0, k + 1
        if n:
            yield packed(first + k, held)

    return prints.select("fp").mapInArrow(run, SENDER)


def answered(codes: DataFrame) -> DataFrame:
    """The owners' replies: for every list of hashes a bitmap of those that came from several places or twice from one."""
    schema = arrow_schema(REPLY)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [opened(r["n"], r["low"], r["code"]) for r in rows]
        twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: r["n"]] for r in rows]
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        met = np.bincount(at, weights=1 + np.concatenate(twice)) > 1
        ends = np.cumsum([r["n"] for r in rows])[:-1]
        bitmaps = [np.packbits(x).tobytes() for x in np.split(met[at], ends)]
        return pa.Table.from_pydict({"sender": [r["sender"] for r in rows], "owner": [r["owner"] for r in rows], "met": bitmaps}, schema=schema)

    return codes.groupBy("owner").applyInArrow(run, REPLY)


def suspects(codes: DataFrame, replies: DataFrame, bits: int, share: int) -> DataFrame:
    """``short``: the hashes that senders read off the replies, each once."""
    schema = arrow_schema("short long")

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                values = opened(r["n"], r["low"], r["code"]) | np.uint64(r["owner"] << (bits - share))
                found.append(values[np.unpackbits(np.frombuffer(r["met"], np.uint8))[: r["n"]] == 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], schema=schema)

    return codes.join(replies, ["sender", "owner"]).drop("twice").mapInArrow(run, "short long").distinct()


def equal_texts(docs: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """``fp, sha, keep_id, group_size`` of the different texts whose hash is suspect; texts are told apart by their bytes."""
    own = texts(docs).withColumn("text", normal()).withColumn("fp", F.xxhash64("text"))
    own = own.withColumn("short", F.shiftrightunsigned("fp", 64 - bits))
    if asked.count() <= SHOWN:
        own = own.join(F.broadcast(asked), "short", "left_semi")
    else:  # hot texts are spread over salts
        salted = asked.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        own = own.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)")).join(salted, ["short", "salt"], "left_semi")
    groups = own.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    text = normal()
    prints = texts(docs).select("doc_id", F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    prints = stage(prints.groupBy("doc_id", "fp", "sha").agg(F.count("*").alias("n")))
    n = prints.agg(F.sum("n")).first()[0] or 0
    bits = min(n.bit_length() + SPARE, 63)
    share = max((n // OWNED).bit_length(), 3)
    repeated = prints.select("fp", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    codes = stage(sent(repeated, bits, share))
    asked = stage(suspects(codes, answered(codes), bits, share))
    groups = stage(equal_texts(docs, asked, bits).filter("group_size > 1"))
    key = ["fp", "sha"]
    hot = groups.filter(F.col("group_size") > n / HOT).select(*key, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = groups.filter(F.col("group_size") <= n / HOT)
    met = prints.join(F.broadcast(hot), key, "left")
    # a row of a hot group asks the cold ones by its id, which spreads it; nothing there answers
    asks = F.when(F.col("hot_size").isNull(), F.col("fp")).otherwise(F.xxhash64("doc_id"))
    sha = F.when(F.col("hot_size").isNull(), F.col("sha"))
    cold = cold.withColumnsRenamed({"fp": "cold_fp", "sha": "cold_sha"})
    found = met.withColumn("ask", asks).withColumn("ask_sha", sha).join(cold, (F.col("ask") == cold.cold_fp) & (F.col("ask_sha") == cold.cold_sha), "left")
    size = F.coalesce("hot_size", "group_size")
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    each = found.select("doc_id", keep.alias("keep_id"), F.coalesce(size, F.lit(1)).alias("group_size"), "sha", F.explode(F.expr("sequence(1, n)")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
