"""Repeated byte strings by suffix arrays, built bucket by bucket with a difference cover.

Texts meet under the anchors of their windows (``anchors``); each block of segments gets a suffix array of its window starts. Positions
whose remainder modulo ``PERIOD`` lies in a difference cover are a sample; their suffixes are ranked beforehand, by doubling, to at least
the window's length. The suffixes are then sorted one bucket of leading bytes at a time, so that only a bucket's keys are in memory: by
their first ``PERIOD`` bytes, and where these tie, by comparing sample ranks at the shift, below ``PERIOD``, at which both suffixes meet
the sample. Neighbours with a common prefix of a window's length are repeats.

Defined results: a null or empty text, or one shorter than a window, loses nothing; rows that repeat id and text are one document; a null
id is a document of its own; extra columns are left out. ``kept`` is binary, since a cut may fall inside a character.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltloom.llm.anchors import CROWD, Kind, covered, repeated_windows, with_windows
from voltloom.llm.frame import mixed, per_batch

WINDOW, GRAM = 200, 64
SHARD = 2 << 20
ROOT = 8
PERIOD = ROOT * ROOT
#: Suffixes sorted at a time.
BUCKET = 1 << 18
#: 0..7 and the multiples of 8: each remainder is a multiple of 8 less a number below 8.
COVER = np.array(sorted({*range(ROOT), *range(0, PERIOD, ROOT)}))


def shifts() -> np.ndarray:
    """For each pair of remainders, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    r = np.arange(PERIOD)
    for s in range(PERIOD - 1, -1, -1):
        hit = inside[(r + s) % PERIOD]
        out[np.ix_(hit, hit)] = s
    return out


SHIFT = shifts()


def eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def refined(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by their first ``length`` bytes, and the number of each one's group. Only what still ties is looked at again."""
    order = np.argsort(eight(text, at), kind="stable")
    key = eight(text, at[order])
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    for depth in range(8, length, 8):
        tied = np.append(False, group[1:] == group[:-1])
        tied[:-1] |= tied[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        key = eight(text, at[order[rows]] + depth)
        inner = np.lexsort((key, group[rows]))
        order[rows] = order[rows[inner]]
        apart = np.zeros(len(at), bool)
        apart[rows[1:]] = key[inner][1:] != key[inner][:-1]
        new = np.append(True, group[1:] != group[:-1]) | apart
        group = np.cumsum(new) - 1
    return order, group


def cover_ranks(text: np.ndarray, size: int, window: int) -> np.ndarray:
    """Rank of each sample position by at least ``window`` bytes; -1 elsewhere."""
    at = np.arange(size)
    at = at[np.isin(at % PERIOD, COVER)]
    order, group = refined(text, at, PERIOD)
    ranks = np.full(size + 2 * PERIOD, -1, np.int64)
    ranks[at[order]] = group
    have = PERIOD
    while have < window:
        behind = np.zeros(len(at), np.int64)
        there = at + have < size
        behind[there] = ranks[at[there] + have] + 1
        key = ranks[at] * (size + 2) + behind
        order = np.argsort(key, kind="stable")
        ranks[at[order]] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        have *= 2
    return ranks


def untie(at: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order within groups that tie on ``PERIOD`` bytes: three-way partitions of all groups at once, by sample ranks against a pivot."""
    order = np.arange(len(at))
    open_rows = order[np.append(False, group[1:] == group[:-1]) | np.append(group[1:] == group[:-1], False)]
    part = group[open_rows]
    while len(open_rows):
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(begin, len(part)))
        pivot = np.repeat(order[open_rows[begin + size // 2]], size)
        own = order[open_rows]
        shift = SHIFT[at[own] % PERIOD, at[pivot] % PERIOD]
        side = np.sign(ranks[at[own] + shift] - ranks[at[pivot] + shift]) + 1
        key = np.repeat(np.arange(len(begin)), size) * 3 + side
        inner = np.argsort(key, kind="stable")
        order[open_rows] = own[inner]
        key = key[inner]
        again = (key % 3 != 1) & (np.append(False, key[1:] == key[:-1]) | np.append(key[1:] == key[:-1], False))
        open_rows, part = open_rows[again], key[again]
    return order


def elsewhere(units: list[bytes], n: np.ndarray, twice: np.ndarray, window: int) -> np.ndarray:
    """Of each window of the segments: whether its bytes start at another place of the block, or its segment has copies."""
    size = sum(map(len, units))
    text = np.zeros(size + 2 * window + PERIOD + 8, np.uint8)
    text[:size] = np.frombuffer(b"".join(units), np.uint8)
    lengths = np.array([len(u) for u in units])
    begin = np.cumsum(lengths) - lengths
    place = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.repeat(twice.astype(bool), n)
    ranks = cover_ranks(text, size, window)
    lead = text[place].astype(np.int64) << 8 | text[place + 1]
    by_lead = np.argsort(lead, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(lead[by_lead])) + 1, len(place))
    start = 0
    while start < len(place):
        end = int(ends[min(len(ends) - 1, np.searchsorted(ends, start + BUCKET))])
        rows = by_lead[start:end]
        order, group = refined(text, place[rows], PERIOD)
        rows = rows[order]
        order = untie(place[rows], group, ranks)
        rows, at = rows[order], place[rows[order]]
        near = np.flatnonzero(group[1:] == group[:-1])
        for depth in [*range(PERIOD, window - 7, 8), window - 8]:
            near = near[eight(text, at[near] + depth) == eight(text, at[near + 1] + depth)]
        out[rows[near]] = out[rows[near + 1]] = True
        start = end
    return out


def byte_units(data: bytes):
    raw = np.frombuffer(data, np.uint8)
    return mixed(raw.astype(np.uint64) + np.uint64(1)), lambda a, b: data[a:b]


def kind(window: int, gram: int, crowd: int = CROWD) -> Kind:
    return Kind(window, gram, False, byte_units, bytes, crowd)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of every row; windows have at least ``PERIOD`` bytes."""
    found = repeated_windows(docs, kind(window, gram, crowd), SHARD, partial(elsewhere, window=window))

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            gone = covered(len(raw), starts, ns, window)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()))
            out["kept"].append(raw[~gone].tobytes())
        return out

    return per_batch(with_windows(docs, found), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", work)
