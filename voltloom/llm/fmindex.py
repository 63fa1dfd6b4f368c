"""Repeated word passages by a compressed FM-index per shard.

Texts meet under the anchors of their windows (``anchors``); each block of segments is a shard. Its words become numbers, its suffixes are
sorted by their first ``window`` words (ties by place), and the Burrows-Wheeler transform of that order is kept as a wavelet matrix: one
packed bit row per bit of the alphabet with a count per 64 bits. The windows of the shard are streamed through backward search, word by
word from the end, all at once; one that only itself matches is dropped, and one matched to full length has its first occurrence at the
start of its interval. A window is reported if that is another, earlier place.

Defined results: a null or empty text, or one shorter than a window, loses nothing; rows that repeat id and text are one document;
rows that share an id but not the text are ordered by a hash of the text; a null id is the last; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.anchors import CROWD, Kind, covered, repeated_windows, rows_with_windows, with_windows
from voltloom.llm.frame import per_batch

WINDOW, GRAM = 20, 8
#: Bytes of word numbers (eight a word) that make a shard.
SHARD = 2 << 20


class Wavelet:
    """Ranks of symbols in a sequence."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = sequence >> level & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            words = np.append(np.pad(packed, (0, -len(packed) % 8)).view("<u8"), np.uint64(0))
            counts = np.append(0, np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)).astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.rows.append((words, counts, zeros))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place in the last row of what stands before ``place``: differences of these are counts of the symbol."""
        for level, (words, counts, zeros) in zip(range(self.bits - 1, -1, -1), self.rows, strict=True):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(words[word] & below)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks and the stable order."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
    return rank, order


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` symbols, ties by place; behind the end is less than anything."""
    n = len(symbols)
    rank, have = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    kept = {1: rank}
    while have < depth:
        more = max(k for k in kept if have + k <= depth)
        behind = np.append(kept[more][have:] + 1, np.zeros(min(have, n), np.int64))[:n]
        rank, order = ranked(rank * (n + 2) + behind)
        have += more
        kept[have] = rank
    return order


def earlier(units: list[bytes], n: np.ndarray, twice: np.ndarray, window: int) -> np.ndarray:
    """Of each window of the segments: whether its words start at an earlier place of the shard."""
    own = [np.frombuffer(u, np.uint64) for u in units]
    number, _ = ranked(np.concatenate(own))
    sizes = np.array([len(u) for u in own])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 ends a segment
    symbols[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = number + 1
    order = suffixes(symbols, window)
    size = int(number.max()) + 2
    less = np.append(0, np.cumsum(np.bincount(symbols, minlength=size)))
    wavelet = Wavelet(symbols[order - 1], size)
    base = wavelet.rank(np.arange(size), np.zeros(size, np.int64))
    place = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    live = np.arange(len(place))
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(symbols))
    for k in range(window - 1, -1, -1):
        word = symbols[place[live] + k]
        low, high = (less[word] + wavelet.rank(word, x) - base[word] for x in (low, high))
        several = high - low > 1
        live, low, high = live[several], low[several], high[several]
    out = np.zeros(len(place), bool)
    out[live] = order[low] != place[live]
    return out


def word_units(data: bytes):
    """``bytes.split`` knows the ASCII white space only."""
    words = data.split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends + 1).tolist()
    ends = ends.tolist()
    return hashes, lambda a, b: joined[starts[a] : ends[b - 1]]


def word_numbers(piece: bytes) -> bytes:
    return word_units(piece)[0].tobytes()


def kind(window: int, gram: int, crowd: int = CROWD) -> Kind:
    return Kind(window, gram, True, word_units, word_numbers, crowd)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words that stay, joined by a space) of every row."""
    found = repeated_windows(docs, kind(window, gram, crowd), SHARD, partial(earlier, window=window))

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept": []}
        for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
            words = text.encode().split()
            gone = covered(len(words), starts, ns, window)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if starts else words).decode())
        return out

    return per_batch(with_windows(docs, found), "doc_id long, n_words long, n_removed long, kept string", work)


def shortened(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The documents, whole, with the repeated words taken out of ``text``; a text without any stays as it is."""
    found = repeated_windows(docs, kind(window, gram, crowd), SHARD, partial(earlier, window=window))
    rows = rows_with_windows(docs, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
                if starts:
                    words = text.encode().split()
                    gone = covered(len(words), starts, ns, window)
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                else:
                    kept.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    schema = rows.select("row", F.lit(None).cast("string").alias("kept")).schema
    text = F.coalesce("kept", "row.text").alias("text")
    return rows.mapInArrow(run, schema).select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
