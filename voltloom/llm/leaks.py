"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Words are lower-cased (A-Z) and freed of ASCII punctuation. A document holds an item of n words if some stretch of it is within ``edits(n)``
word edits. Items are taken in blocks of at most ``BLOCK``, and each block meets every document in one pass without a shuffle:

1. Windows of an item's size start at every word. By the q-gram lemma a window within e edits shares n - 3e - 2 of the item's three-word
   shingles; windows with fewer shingles of any item of that size class are passed over, which loses nothing.
2. The CGK walk reads a window word by word: in step j it writes the word it stands on and moves on if a random bit of (j, word) says so.
   Texts a few edits apart walk together again and so agree in most places. ``tables`` hash keys of ``PLACES`` sampled places each are
   compared with the items'; their number follows from the target recall and the agreement to be expected at the threshold.
3. What shares a key is verified by the exact edit distance of the item to the best stretch around the window.

Defined results: null or empty texts hold nothing and null or empty items are in nothing; an item of one or two words is looked for in no
text; rows that repeat an id and text give the same rows again; each row has one result per item; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.anchors import KEY, keyed
from voltloom.llm.frame import arrow_schema, keep_rows, mixed

BLOCK = 4096
GRAM = 3
#: Edits per word of the item.
RATE = 0.2
RECALL, AGREEMENT, PLACES = 0.99, 0.55, 4
#: Tables that share one walk.
TOGETHER = 4
#: Items of n words are in class n // STEP.
STEP = 8
SLOTS = 1 << 22
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def edits(n: int) -> int:
    """Kept so low that one shared shingle is certain."""
    return max(0, min(int(RATE * n), (n - 3) // 3))


def tables(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**PLACES))


def hashed(text: str) -> np.ndarray:
    words = text.encode().lower().translate(None, PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mixed((words[:-2] * np.uint64(0x9FB21C651E98DF25) + words[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + words[2:])


def distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where that ends (bit-parallel, one bit a word of the item)."""
    n = len(item)
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for k, w in enumerate(text, 1):
        eq = at.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(zero | up) & full, up & zero
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(zero | rise) & full, rise & zero
        if score < best:
            best, end = score, k
    return best, end


class Sketch:
    """LSH of windows: walk and sampled places of every table, the same wherever it is made."""

    def __init__(self, classes: list[int], recall: float = RECALL):
        self.classes, self.tables = classes, tables(recall)
        draw = np.random.default_rng(7)
        self.seeds = draw.integers(1, 1 << 62, (math.ceil(self.tables / TOGETHER), 2 * STEP * (max(classes, default=0) + 1)), np.uint64)
        self.places = {c: [set(draw.integers(0, self.steps(c), PLACES).tolist()) for _ in range(self.tables)] for c in classes}

    @staticmethod
    def steps(c: int) -> int:
        return max(6, 2 * STEP * c)

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Class, table and key of each window; behind its text's end a window reads zeros."""
        most = max(map(self.steps, self.classes))
        words = np.append(words, np.uint64(0))
        with np.errstate(over="ignore"):
            for walk, seeds in enumerate(self.seeds):
                mine = [(c, t) for c in self.classes for t in range(walk * TOGETHER, min(self.tables, (walk + 1) * TOGETHER))]
                keys = {x: np.full(len(starts), x[1], np.uint64) for x in mine}
                at = starts.copy()
                for j in range(most):
                    word = words[np.where(at < ends, at, len(words) - 1)]
                    for c, t in mine:
                        if j in self.places[c][t]:
                            keys[c, t] = (keys[c, t] ^ word) * np.uint64(0xA0761D6478BD642F) + np.uint64(j)
                    at += ((word ^ seeds[j]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(np.int64)
                for (c, t), key in keys.items():
                    yield c, t, key


class Items:
    """A block of items, ready to be met."""

    def __init__(self, ids: list[int], texts: list[str], recall: float = RECALL):
        own = [(i, w) for i, t in zip(ids, texts, strict=True) if len(w := hashed(t)) >= GRAM]
        self.ids, self.words = [i for i, _ in own], [w.tolist() for _, w in own]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.classes = sorted(set((sizes // STEP).tolist()))
        self.hot = np.zeros(SLOTS, bool)
        self.need: dict[int, tuple[int, int]] = {}
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if not own:
            return
        for _, w in own:
            self.hot[(shingles(w) % np.uint64(SLOTS)).astype(np.int64)] = True
        for c in self.classes:
            mine = sizes[sizes // STEP == c].tolist()
            self.need[c] = (min(n - GRAM * edits(n) - 2 for n in mine), max(n + edits(n) for n in mine))
        self.sketch = Sketch(self.classes, recall)
        ends = np.cumsum(sizes)
        for c, t, key in self.sketch.keys(np.concatenate([w for _, w in own]), ends - sizes, ends):
            rows = np.flatnonzero(sizes // STEP == c)
            order = rows[np.argsort(key[rows], kind="stable")]
            self.found[c, t] = key[order], order

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """``(text, start, item)`` of windows that share a key with an item."""
        if not self.ids:
            return
        kept: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, words in enumerate(texts):
            hits = self.hot[(shingles(words) % np.uint64(SLOTS)).astype(np.int64)]
            if hits.any():
                before = np.append(0, np.cumsum(hits))
                start = np.arange(len(words))
                limit = lambda x: np.clip(x, 0, len(hits))
                fits = np.stack([before[limit(start + span - GRAM + 1)] - before[limit(start)] >= need for need, span in map(self.need.get, self.classes)])
                rows = np.flatnonzero(fits.any(0))
                if len(rows):
                    kept.append((k, words, rows, fits[:, rows]))
        if not kept:
            return
        sizes = np.array([len(w) for _, w, _, _ in kept])
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(kept)), [len(r) for _, _, r, _ in kept])
        local = np.concatenate([r for _, _, r, _ in kept])
        fits = dict(zip(self.classes, np.concatenate([f for *_, f in kept], 1), strict=True))
        for c, t, key in self.sketch.keys(np.concatenate([w for _, w, _, _ in kept]), local + (ends - sizes)[text], ends[text]):
            known, order = self.found[c, t]
            low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            for row in np.flatnonzero((high > low) & fits[c]).tolist():
                for item in order[low[row] : high[row]].tolist():
                    yield kept[text[row]][0], int(local[row]), item

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, distance, end, words)`` of verified items, the best stretch of each."""
        starts: dict[tuple[int, int], set[int]] = {}
        for text, start, item in self.candidates(texts):
            starts.setdefault((text, item), set()).add(start)
        for (text, item), found in sorted(starts.items()):
            words = self.words[item]
            n, room = len(words), edits(len(words))
            best, done = (room + 1, 0), 0
            for start in sorted(found):
                low, high = max(start - room - 1, 0), start + n + 2 * room
                if high > done:
                    low = max(low, done - n - room) if done else low
                    d, end = distance(words, texts[text][low:high].tolist())
                    best, done = min(best, (d, low + end)), high
            if best[0] <= room:
                yield text, item, best[0], best[1], n


HITS = "doc_id long, mark long, item_id long, edits int, word_end long, item_words int"


def blocks(items: DataFrame) -> Iterator[list]:
    """Different items in sorted blocks of about ``BLOCK``."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).dropna().distinct()
    parts = max(1, math.ceil(own.count() / BLOCK))
    for part in range(parts):
        yield sorted(own.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == part).collect())


def leaks(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, mark, item_id, edits, word_end, item_words``: items found in each document; ``mark`` is a hash of the text."""
    schema = arrow_schema(HITS)
    source, out = keyed(docs), None
    for rows in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            ready = Items([r[0] for r in rows], [r[1] for r in rows], recall)
            for batch in batches:
                texts = [hashed(t) for t in batch.column("text").to_pylist()]
                ids, marks = (batch.column(c).to_pylist() for c in KEY)
                found = [(ids[k], marks[k], ready.ids[i], d, end, n) for k, i, d, end, n in ready.hits(texts)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema, strict=True)], schema=schema)

        met = source.mapInArrow(run, HITS)
        out = met if out is None else out.unionByName(met)
    return out


def clean(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents, whole, that hold no item."""
    for rows in blocks(items):
        ready: list[Items] = []

        def keep(batch: pa.RecordBatch, rows: list = rows, ready: list = ready) -> np.ndarray:
            if not ready:
                ready.append(Items([r[0] for r in rows], [r[1] for r in rows], recall))
            out = np.ones(batch.num_rows, bool)
            for k, *_ in ready[0].hits([hashed(t) for t in batch.column("text").to_pylist()]):
                out[k] = False
            return out

        docs = keep_rows(docs, keep)
    return docs
