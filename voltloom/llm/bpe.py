"""BPE with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens. It starts as one state with a loop for every byte. The
gadget of a merge (u, v) -> w copies the state behind u without its v arc, lets u lead to the copy, and adds an arc w to where v led.
What a path through the finished automaton spells is the tokenization of its bytes, and each text has exactly one path.

A copied state differs from its origin by one arc, so states are kept as that difference: ``cut`` of (u, v) is the time at which the v arc
behind u went, and the state behind a token is the cuts of its right spine, each up to the time its member was merged away. An arc y
exists there if no member of y's left spine was cut while both lived. ``Automaton.step`` is this transition function, tabulated as it is
used; texts are split into words first, and a word is entered from the left through a trie of the reversed tokens.

Defined results: a null text is empty and gives no ids; an empty text gives no ids; text of an added token (``<|endoftext|>``) gives its
id; repeated rows and ids give repeated rows; extra columns are left out.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voltloom.llm.frame import per_batch, texts

#: Fixed value: the word pattern of the byte-level tokenizer files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker remembers before it starts anew; this bounds memory only.
REMEMBERED = 80_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int]):
        letters = byte_letters()
        self.label = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.label |= {i: t.encode() for t, i in added.items()}
        self.added = added
        self.born: dict[int, int] = {vocab[c]: -1 for c in letters if c in vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for time, merge in enumerate(merges):
            self.gadget(*(vocab[x] for x in (merge if len(merge) == 2 else merge.split(" "))), vocab["".join(merge) if len(merge) == 2 else merge.replace(" ", "")], time)
        self.arcs: dict[int, int] = {}
        self.spelled = [-1]
        for token in self.born:
            node = 0
            for b in reversed(self.label[token]):
                key = node << 8 | b
                if key not in self.arcs:
                    self.arcs[key] = len(self.spelled)
                    self.spelled.append(-1)
                node = self.arcs[key]
            self.spelled[node] = token

    def gadget(self, u: int, v: int, w: int, time: int) -> None:
        """Cut the v arc behind u at this time; the arc w exists if u and v could still follow each other."""
        if u in self.born and v in self.born and w not in self.born and self.follows(u, v):
            self.born[w] = time
            self.parts[w] = u, v
        self.cut[u << 32 | v] = time

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outermost parts on a side, each with the time at which it was merged away."""
        out = [(token, NEVER)]
        while token in self.parts:
            end = self.born[token]
            token = self.parts[token][side]
            out.append((token, end))
        return out

    def follows(self, a: int, b: int) -> bool:
        left = self.spine(b, 0)
        for x, x_end in self.spine(a, 1):
            for y, y_end in left:
                time = self.cut.get(x << 32 | y)
                if time is not None and time < x_end and (time < y_end or time == y_end and x == y):
                    return False
        return True

    def step(self, a: int, b: int) -> bool:
        """Whether the state behind token a has an arc b."""
        key = a << 32 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2 * REMEMBERED:
                self.table.clear()
            known = self.table[key] = self.follows(a, b)
        return known

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words in sorted order. The path to a position depends only on the bytes before it, so a word starts where its
        common prefix with the word before ends. A position is entered by the one token that the state before it has an arc for."""
        label, table, arcs, spelled = self.label, self.table, self.arcs, self.spelled
        entered: list[int] = []
        last, out = b"", []
        for word in words:
            n, same = len(word), 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            del entered[same:]
            for end in range(same, n):
                node = 0
                for start in range(end, -1, -1):
                    node = arcs.get(node << 8 | word[start])
                    if node is None:
                        raise ValueError("no path spells this word")
                    token = spelled[node]
                    if token >= 0:
                        if not start:
                            break
                        key = entered[start - 1] << 32 | token
                        lawful = table.get(key)
                        if lawful is None:
                            lawful = self.step(key >> 32, token)
                        if lawful:
                            break
                entered.append(token)
            ids, at = [], n
            while at:
                token = entered[at - 1]
                ids.append(token)
                at -= len(label[token])
            out.append(ids[::-1])
            last = word
        return out


class Words:
    """Ids of words met lately. When there are many, those not met again since the last time go."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        out = []
        for w in words.difference(self.known):
            ids = self.before.get(w)
            if ids is None:
                out.append(w)
            else:
                self.known[w] = ids
        return out


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Automaton, Words, regex.Pattern, regex.Pattern | None]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    automaton = Automaton(spec["model"]["vocab"], spec["model"]["merges"], added)
    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return automaton, Words(), regex.compile(SPLIT), marks


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    automaton, words, split, marks = load(path)
    parts = []
    for text in texts:
        if marks is None or not any(mark in text for mark in automaton.added):
            parts.append(split.findall(text))
        else:
            parts.append([w for k, x in enumerate(marks.split(text)) for w in ([x] if k % 2 else split.findall(x))])
    new = {w.encode(): w for w in words.missing(set().union(*parts))}
    known, order = words.known, sorted(new)
    known.update((new[b], np.array(ids, "<u4").tobytes()) for b, ids in zip(order, automaton.encode(order), strict=True))
    known.update((mark, np.array([i], "<u4").tobytes()) for mark, i in automaton.added.items())
    return [b"".join(map(known.__getitem__, own)) for own in parts]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) of every text, with the byte-level vocabulary file at ``path``."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": encode_texts(batch.column("text").to_pylist(), path)}

    return per_batch(texts(docs), "doc_id long, ids binary", work)


def decode_ids(ids: bytes | None, path: str) -> str:
    """The labels of the arcs in a row, read as UTF-8. Ids without a label are left out, null ids are none."""
    label = load(path)[0].label
    return b"".join([label.get(i, b"") for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` of encoded rows."""

    def work(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids")
        return {"doc_id": batch.column("doc_id"), "ids": ids, "text": [decode_ids(x, path) for x in ids.to_pylist()]}

    return per_batch(encoded.select("doc_id", "ids"), "doc_id long, ids binary, text string", work)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task needs one worker with one automaton."""

    def work(batch: pa.RecordBatch) -> dict:
        ids = encode_texts(batch.column("text").to_pylist(), path)
        return {"doc_id": batch.column("doc_id"), "ids": ids, "text": [decode_ids(x, path) for x in ids]}

    return per_batch(texts(docs), "doc_id long, ids binary, text string", work)
