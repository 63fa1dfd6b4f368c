"""Verdicts on urls: rules first, then naive Bayes over words split out of host and path.

Host names often run words together. The words that could be in them are counted over all page texts (one count table, joined with the
substrings of the different host labels, never gathered), and a unigram Viterbi splits each label into its likeliest words. Urls that a
rule decides are the training rows of a multinomial naive Bayes over hashed tokens (``SLOTS``), with class priors and one added count;
it judges the urls that no rule fits.

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the prior; a longest rule that ties cannot
occur (rules are distinct); repeated rows are judged alike and counted as often as they occur; without any url that a rule decides, the
verdict is allow; extra columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.llm.frame import arrow_schema, per_batch
from voltloom.session import stage

#: Hashed tokens; the model is two counts for each, which bounds what is sent to the tasks.
SLOTS = 1 << 14
#: Letters of a word in a host label.
LONGEST = 20
#: Parts of a host's rows, so that one host may hold any share of the table.
SALT = 32
MARKUP = r"<[^>]*>"
ZONES = {"www", "m", "blog"}


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, settled``: rules are (verdict, host, path); the longest that fits wins."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, zone, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == zone) | F.col("host").endswith("." + zone)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(zone + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return parts.select("*", rule.alias("rule"), verdict.alias("settled"))


def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Likeliest words by unigram Viterbi; a letter outside the counted words costs more the longer the unknown word."""
    best, back = [0.0] + [-1e18] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            n = counts.get(word, 0)
            cost = np.log(n / total) if n else -np.log(total + 1.0) - 2.3 * len(word)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    out, at = [], len(label)
    while at:
        out.append(label[back[at] : at])
        at = back[at]
    return out[::-1]


def host_words(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, words`` of each different host."""
    labels = hosts.select("host", F.posexplode(F.split("host", "[.-]")).alias("place", "label"))
    different = labels.select("label").distinct()
    pieces = F.expr(
        f"flatten(transform(sequence(1, greatest(1, length(label))), a -> transform(sequence(1, {LONGEST}), n -> substring(label, a, n))))"
    )
    substrings = different.select("label", F.explode(F.array_distinct(pieces)).alias("word")).filter("word <> ''")
    text = F.regexp_replace(F.col("html"), MARKUP, " ")
    counted = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).filter(f"word <> '' and length(word) <= {LONGEST}")
    counts = stage(counted.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    known = substrings.join(counts, "word").groupBy("label").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    def work(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(c).to_pylist() for c in ("label", "words", "ns")), strict=True)
        return {"label": batch.column("label"), "split": [split_label(x, dict(zip(w or [], n or [], strict=True)), total) for x, w, n in rows]}

    split = per_batch(different.join(known, "label", "left"), "label string, split array<string>", work)
    ordered = F.array_sort(F.collect_list(F.struct("place", "split")))
    return labels.join(split, "label").groupBy("host").agg(ordered.alias("s")).select("host", F.flatten("s.split").alias("words"))


def tokens(words: list[str], path: str) -> list[int]:
    """Slots of the words of the host, marked as such, and of the path; numbers are one token."""
    found = [f"h:{w}" for w in words if w not in ZONES] + [f"p:{'#' if w.isdigit() else w.lower()}" for w in re.findall(r"\w+", path)]
    return [xxhash.xxh3_64_intdigest(t) % SLOTS for t in found]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict, words``."""
    parts = stage(ruled(pages, rules))
    words = stage(host_words(parts.select("host").distinct(), pages))
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = stage(parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt"))
    schema = arrow_schema("settled string, slot int, n long")

    def count(batches):
        sums, rows = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for verdict, own, path in zip(*(batch.column(c).to_pylist() for c in ("settled", "words", "path")), strict=True):
                at = int(verdict == "block")
                np.add.at(sums[at], tokens(own or [], path), 1)
                rows[at] += 1
        for at, name in enumerate(("allow", "block")):
            slots = np.flatnonzero(sums[at])
            yield pa.RecordBatch.from_pydict({"settled": [name] * (len(slots) + 1), "slot": [*slots.tolist(), -1], "n": [*sums[at][slots].tolist(), int(rows[at])]}, schema=schema)

    counted = joined.filter("settled is not null").mapInArrow(count, "settled string, slot int, n long")
    seen = np.zeros((2, SLOTS + 1))
    for r in counted.groupBy("settled", "slot").agg(F.sum("n").alias("n")).collect():  # at most 2 * (SLOTS + 1) rows
        seen[int(r.settled == "block"), r.slot] = r.n
    priors = np.log(seen[:, -1] + (1, 0.5)) if seen[:, -1].sum() else np.array([0.0, -1.0])
    chances = np.log((seen[:, :-1] + 1) / (seen[:, :-1].sum(1, keepdims=True) + SLOTS))
    odds, start = chances[1] - chances[0], priors[1] - priors[0]

    def decide(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in ("page_id", "host", "path", "rule", "words")}
        verdicts = []
        for settled, own, path in zip(*(batch.column(c).to_pylist() for c in ("settled", "words", "path")), strict=True):
            verdicts.append(settled or ("block" if start + odds[tokens(own or [], path)].sum() > 0 else "allow"))
        return out | {"verdict": verdicts}

    return per_batch(joined, "page_id long, host string, path string, rule string, words array<string>, verdict string", decide)
