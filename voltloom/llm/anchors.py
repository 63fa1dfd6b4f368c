"""Where texts share windows of fixed length: the stages that two repeat finders have in common.

A window's anchor is the least hash of the grams in it, so equal windows have equal anchors; windows in a row with one anchor form a
segment. Segments meet under their anchor:

1. each task cuts its texts into segments and keeps one of each kind of its own (a common passage costs a task one row);
2. under each anchor, equal segments are one class. A class alone under its anchor is settled by its number of copies. Where several
   classes meet, or a segment may repeat itself, the first copy of each class is asked for;
3. asked segments are cut out of the texts and gathered by anchor, sorted, in blocks of whole anchors; the caller's index decides which
   of their windows occur elsewhere;
4. windows found are collected per document.

An anchor with more than ``crowd`` classes is asked for window by window under the hash of each whole window, which splits it without
losing a pair. Documents are told apart by id and text: rows that repeat both are one document. A null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.frame import arrow_schema, mixed, texts
from voltloom.session import stage

#: Units (bytes or words) worked on at a time within a task.
CHUNK = 1 << 18
#: Windows of one segment at most; a longer one is cut.
LONGEST = 512
CROWD = 20_000
NO_ID = np.iinfo(np.int64).max
KEY = ["doc_id", "mark"]


@dataclass(frozen=True)
class Kind:
    """What windows consist of. ``split`` gives the hash of each unit and a function that cuts units [a, b) out as bytes."""

    window: int
    gram: int
    first_stays: bool
    split: Callable[[bytes], tuple[np.ndarray, Callable[[int, int], bytes]]]
    payload: Callable[[bytes], bytes]
    crowd: int = CROWD


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def doubled(x: np.ndarray, width: int, merge: Callable) -> np.ndarray:
    """merge over every ``width`` values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        x = merge(x[:-have], x[have:], have)
        have *= 2
    return merge(x[: len(x) - (width - have)], x[width - have :], have) if have < width else x


def segments(units: np.ndarray, borders: np.ndarray, kind: Kind) -> dict[str, np.ndarray]:
    """Segments of the texts whose units lie between the borders: text, start in the text, windows, anchor, whether it may repeat itself."""
    width = kind.window - kind.gram + 1
    sizes = np.diff(borders)
    at = np.repeat(np.arange(len(sizes)), np.maximum(sizes - kind.window + 1, 0))
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "anchor", "again")}
    counts = np.maximum(sizes - kind.window + 1, 0)
    valid = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + borders[at]
    with np.errstate(over="ignore"):
        grams = doubled(units, kind.gram, lambda a, b, n: a * np.uint64(0x9FB21C651E98DF25 + 2 * n) + b)
    grams = mixed(grams)
    least = doubled(grams, width, lambda a, b, n: np.minimum(a, b))
    value = least[valid]
    new = np.append(True, (value[1:] != value[:-1]) | (np.diff(valid) != 1) | (np.diff(at) != 0))
    begin = np.flatnonzero(new)
    inside = np.arange(len(valid)) - np.repeat(begin, np.diff(np.append(begin, len(valid))))
    begin = np.flatnonzero(new | (inside % LONGEST == 0))
    n = np.diff(np.append(begin, len(valid)))
    # a gram is an anchor if it is the least of some window; two anchors in a row that are alike may be a segment that repeats itself
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(doubled(padded, width, lambda a, b, n: np.maximum(a, b))[: len(grams)] == grams)
    alike = places[:-1][grams[places[1:]] == grams[places[:-1]]] if len(places) else places
    first = valid[begin]
    again = np.searchsorted(alike, first + n + width - 1) > np.searchsorted(alike, first)
    return {"text": at[begin], "start": first - borders[at[begin]], "n": n, "anchor": value[begin].view(np.int64), "again": again}


def chunks(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple[np.ndarray, dict, np.ndarray]]:
    """Row of each segment, the segments, and the hash of each one's content, some texts at a time."""
    held: list[tuple[int, np.ndarray, Callable]] = []
    total = 0

    def done():
        borders = np.cumsum([0, *(len(u) for _, u, _ in held)])
        found = segments(np.concatenate([u for _, u, _ in held]), borders, kind)
        ends = (found["start"] + found["n"] + kind.window - 1).tolist()
        digest = xxhash.xxh3_64_intdigest
        content = np.array([digest(held[t][2](a, b)) for t, a, b in zip(found["text"].tolist(), found["start"].tolist(), ends, strict=True)], np.uint64)
        return np.array([r for r, _, _ in held])[found["text"]], found, content.view(np.int64)

    for row, text in enumerate(batch.column("text").to_pylist()):
        units, cut = kind.split(text.encode())
        if len(units) >= kind.window:
            held.append((row, units, cut))
            total += len(units)
        if total >= CHUNK:
            yield done()
            held, total = [], 0
    if held:
        yield done()


ROWS = "route long, settled boolean, anchor long, content long, doc_id long, mark long, start int, n int, again boolean, copies int"
ASKED = "settled boolean, anchor long, doc_id long, mark long, start int, n int, twice boolean, fine boolean"


def cut_up(docs: DataFrame, kind: Kind) -> DataFrame:
    """Step 1."""
    schema = arrow_schema(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
            for row, s, content in chunks(batch, kind):
                doc, mark = ids[row], marks[row]
                order = np.lexsort((s["start"], mark, doc, content, s["anchor"]))
                doc, mark, content = doc[order], mark[order], content[order]
                start, n, anchor, again = (s[k][order] for k in ("start", "n", "anchor", "again"))
                fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
                same = np.append(False, ~fresh[1:] & (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1]))
                doc, mark, content, start, n, anchor, again, fresh = (x[~same] for x in (doc, mark, content, start, n, anchor, again, fresh))
                head = np.flatnonzero(fresh)
                copies = np.diff(np.append(head, len(fresh)))
                many = np.repeat(copies, copies) > 1
                settled = ~fresh if kind.first_stays else many
                spare = mixed((doc * 31 + start).view(np.uint64)).view(np.int64)
                parts = (
                    (anchor, np.zeros(len(doc), bool), fresh, np.repeat(copies, copies)), (spare, np.ones(len(doc), bool), settled, np.ones(len(doc), np.int64)),
                )
                for route, done, take, copy in parts:
                    if take.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[take]).cast(f.type) for x, f in zip((route, done, anchor, content, doc, mark, start, n, again, copy), schema, strict=True)], schema=schema)

    return keyed(docs).mapInArrow(run, ROWS)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int, size: Callable[[pa.Table], int]) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, in tables that end with a key's last row and have at least that size."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += size(batch)
        last = held[-1].column(key)
        if total < least or held[0].column(key)[0] == last[-1]:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        border = int(np.searchsorted(keys, keys[-1]))
        if border:
            yield table.slice(0, border).combine_chunks()
            held = table.slice(border).combine_chunks().to_batches()
            total = sum(map(size, held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def meet(rows: DataFrame, kind: Kind) -> DataFrame:
    """Step 2: windows settled, and segments asked for."""
    schema = arrow_schema(ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "route", 1 << 16, lambda b: b.num_rows):
            c = {k: table.column(k).to_numpy() for k in table.column_names}
            order = np.lexsort((c["start"], c["mark"], c["doc_id"], c["content"], c["anchor"], c["settled"]))
            c = {k: v[order] for k, v in c.items()}
            settled = c["settled"]
            fresh = np.append(True, (c["anchor"][1:] != c["anchor"][:-1]) | (c["content"][1:] != c["content"][:-1]) | settled[1:] | settled[:-1])
            same = np.append(False, ~fresh[1:] & (np.diff(c["doc_id"]) == 0) & (np.diff(c["mark"]) == 0) & (np.diff(c["start"]) == 0))
            group = np.cumsum(fresh) - 1
            copies = np.bincount(group, weights=np.where(same, 0, c["copies"])).astype(np.int64)[group]
            anew = np.append(True, (c["anchor"][1:] != c["anchor"][:-1]) | (settled[1:] != settled[:-1]))
            under = np.cumsum(anew) - 1
            classes = np.bincount(under, weights=fresh)[under]
            again = np.bincount(group, weights=c["again"])[group] > 0
            asked = ~settled & fresh & ((classes > 1) | again)
            if not kind.first_stays:
                asked &= (copies < 2) | (classes > 1)
            found = settled | (~fresh & ~same if kind.first_stays else (copies > 1) & (c["copies"] == 1) & ~same)
            for take, done in ((found, True), (asked, False)):
                if take.any():
                    n = int(take.sum())
                    values = (np.full(n, done), c["anchor"][take], c["doc_id"][take], c["mark"][take], c["start"][take], c["n"][take], copies[take] > 1, classes[take] > kind.crowd)
                    yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, ASKED)


CUT = "anchor long, doc_id long, mark long, start int, n int, twice boolean, units binary"
WINDOWS = "doc_id long, mark long, start int, n int"


def cut_out(docs: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """Step 3: the asked segments with their units."""
    schema = arrow_schema(CUT)
    fields = ("anchor", "start", "n", "twice", "fine")
    wanted = asked.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("s")).select(*KEY, *[F.col(f"s.{f}").alias(f) for f in fields])
    joined = keyed(docs).join(wanted, KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                _, cut = kind.split(row["text"].encode())
                out: dict = {f.name: [] for f in schema}
                for anchor, start, n, twice, fine in zip(*(row[f] for f in fields), strict=True):
                    for a, m in ((start + j, 1) for j in range(n)) if fine else ((start, n),):
                        piece = cut(a, a + m + kind.window - 1)
                        name = xxhash.xxh3_64_intdigest(piece) - (1 << 63) if fine else anchor
                        for key, value in zip(out, (name, row["doc_id"], row["mark"], a, m, twice, kind.payload(piece)), strict=True):
                            out[key].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return joined.mapInArrow(run, CUT)


def decide(cuts: DataFrame, least: int, index: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Step 3, index: ``index(units, windows, twice)`` says of each window of the segments, in a row, whether it occurs elsewhere."""
    schema = arrow_schema(WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor", least, lambda b: b.column("units").nbytes):
            n = table.column("n").to_numpy().astype(np.int64)
            hit = index(table.column("units").to_pylist(), n, table.column("twice").to_numpy())
            own = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            new = np.append(True, (np.diff(at) != 1) | (np.diff(own[at]) != 0))
            first = at[new]
            long = np.diff(np.append(np.flatnonzero(new), len(at)))
            row = own[first]
            values = (table.column("doc_id").to_numpy()[row], table.column("mark").to_numpy()[row], table.column("start").to_numpy()[row] + offset[first], long)
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return cuts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "mark", "start").mapInArrow(run, WINDOWS)


def repeated_windows(docs: DataFrame, kind: Kind, least: int, index: Callable) -> DataFrame:
    """``doc_id, mark, starts, ns``: runs of windows that occur elsewhere (or earlier), per document."""
    met = stage(meet(cut_up(docs, kind), kind))
    cuts = cut_out(docs, met.filter("not settled"), kind)
    found = met.filter("settled").select("doc_id", "mark", "start", "n").unionByName(decide(cuts, least, index))
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("s")).select(*KEY, F.col("s.start").alias("starts"), F.col("s.n").alias("ns"))


def covered(size: int, starts: list[int] | None, ns: list[int] | None, window: int) -> np.ndarray:
    """Which units the runs of windows cover."""
    change = np.zeros(size + 1, np.int64)
    if starts:
        begin = np.array(starts, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + np.array(ns, np.int64) + window - 1, -1)
    return np.cumsum(change)[:size] > 0


def rows_with_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row, whole, as ``row``, with its text and runs."""
    row = docs.select(F.struct("*").alias("row"))
    own = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    return own.withColumn("mark", F.xxhash64("text")).join(found, KEY, "left").select("row", "text", "starts", "ns")


def with_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its id (null again where it was), text and runs."""
    return keyed(docs).join(found, KEY, "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "starts", "ns")
