"""Toxicity from a learnt lexicon, misspellings included.

The lexicon is learnt from at most ``SAMPLE`` labelled rows: words that far more toxic than clean documents hold, in different company.
A stem that many such words share counts as a term with any ending. The terms form a trie; their Levenshtein automata (one edit from five letters on, two from nine) run on it together: a state is the
set of trie nodes with the edits spent on the way, made deterministic as texts are read and tabulated. Sorted words share the states of
their common prefix. A hit inside quotation marks that open before it and close after it, within ``WINDOW`` words, is a quotation; hits
are summed by (exact or misspelled) x (plain or quoted), and a logistic model weighs them. A form near a term that clean documents hold as
often as toxic ones is a word of its own, no misspelling.

Defined results: a null or empty text has no hits and gets the lowest score; without labels nothing is toxic; repeated rows get the
same score; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from voltloom.llm.folds import held_out, labelled
from voltloom.llm.frame import per_batch, texts
from voltloom.session import stage

SAMPLE = 8000
THRESHOLD = 0.5
WINDOW = 12
#: A lexicon word is that much likelier in toxic documents; the likelihood ratio has to outweigh the parts looked at by so much.
LEAST_ODDS, CAUTION = 20.0, 3.0
#: Letters of a stem.
STEMS = range(3, 9)
LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}']+")
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
#: States and words a worker remembers before it starts anew; this bounds memory only.
REMEMBERED = 300_000


def edits(word: str) -> int:
    """A stem, which ends with an asterisk, has to be met as it is."""
    return 0 if len(word) < 5 or word[-1] == "*" else 1 if len(word) < 9 else 2


class Lexicon:
    """Levenshtein automata of all terms, on their trie."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms)
        self.arcs: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.room: list[int] = [0]
        self.open: set[int] = set()
        for k, term in enumerate(self.terms):
            node = 0
            for letter in term.removesuffix("*"):
                self.room[node] = max(self.room[node], edits(term))
                if letter not in self.arcs[node]:
                    self.arcs[node][letter] = len(self.term)
                    self.arcs.append({})
                    self.term.append(-1)
                    self.room.append(0)
                node = self.arcs[node][letter]
            self.room[node] = max(self.room[node], edits(term))
            self.term[node] = k
            if term[-1] == "*":
                self.open.add(node)
        self.start = self.closed({0: 0})
        self.forget()

    def forget(self) -> None:
        self.table: dict[tuple, tuple] = {}
        self.words: dict[str, tuple[int, int] | None] = {}

    def closed(self, spent: dict[int, int]) -> tuple:
        """With the nodes that are reached by leaving letters out."""
        todo = list(spent.items())
        while todo:
            node, e = todo.pop()
            if e < self.room[node] and e <= spent[node]:
                for to in self.arcs[node].values():
                    if e + 1 < spent.get(to, 9) and e < self.room[to]:
                        spent[to] = e + 1
                        todo.append((to, e + 1))
        return tuple(sorted(spent.items()))

    def step(self, state: tuple, letter: str) -> tuple:
        spent: dict[int, int] = {}
        for node, e in state:
            if (to := self.arcs[node].get(letter)) is not None and e < spent.get(to, 9) and e <= self.room[to]:
                spent[to] = e
            if node in self.open and not e:
                spent[node] = 0
            if e < self.room[node]:
                if e + 1 < spent.get(node, 9):
                    spent[node] = e + 1
                for to in self.arcs[node].values():
                    if e + 1 < spent.get(to, 9) and e < self.room[to]:
                        spent[to] = e + 1
        return self.closed(spent)

    def look_up(self, words: set[str]) -> dict[str, tuple[int, int] | None]:
        """``(term, edits)`` of each word, or None."""
        if len(self.words) + len(self.table) > REMEMBERED:
            self.forget()
        path, last = [self.start], ""
        for word in sorted(words.difference(self.words)):
            same = 0
            for x, y in zip(word, last[: len(path) - 1]):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            for letter in word[same:]:
                key = (path[-1], letter)
                state = self.table.get(key)
                if state is None:
                    state = self.table[key] = self.step(*key)
                path.append(state)
                if not state:
                    break
            last = word
            found = None
            if len(path) == len(word) + 1:
                ends = [(e, self.term[node]) for node, e in path[-1] if self.term[node] >= 0 and e <= edits(self.terms[self.term[node]])]
                found = min(ends)[::-1] if ends else None
            self.words[word] = found
        return self.words


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens before and closes after, at most ``WINDOW`` words away and on the same line."""
    before = " ".join(text[max(0, start - 40 * WINDOW) : start].rsplit("\n", 1)[-1].split(" ")[-WINDOW:])
    after = " ".join(text[end : end + 40 * WINDOW].split("\n", 1)[0].split(" ")[:WINDOW])
    opened = max(before.rfind(x) for x in OPENING)
    if opened < 0 or not any(x in after for x in CLOSING):
        return False
    return before[opened] != '"' or before.count('"') % 2 == 1


@dataclass(frozen=True)
class Forms:
    """In how many toxic and clean documents of the sample each term, and each form within its edits, is met."""

    met: dict[str, tuple[int, int]]
    toxic: int = 0
    clean: int = 0

    def other(self, word: str, label: int | None = None) -> bool:
        """Whether clean documents hold the form at least as often as toxic ones: then it is a word of its own and no misspelling.

        The document that is judged does not count itself if its label is known, so that training meets forms as new texts do."""
        if word not in self.met:
            return False
        t, c = self.met[word]
        t, c = t - (label == 1), c - (label == 0)
        return c > 0 and t * self.clean <= c * self.toxic

    def evidence(self, word: str, label: int | None = None) -> float:
        """Log odds of toxic to clean documents that hold the form, not below zero; of an unmet form those of half a document each."""
        t, c = self.met.get(word, (0, 0))
        if word in self.met:
            t, c = t - (label == 1), c - (label == 0)
        return max(0.0, math.log((t + 0.5) / (self.toxic + 1)) - math.log((c + 0.5) / (self.clean + 1)))


def figures(batch: list[str], lexicon: Lexicon, forms: Forms, labels: list[int | None] | None = None) -> np.ndarray:
    """Per text: exact plain, misspelled plain, exact quoted, misspelled quoted hits (logarithms), different words hit, hits per word, and
    the evidence of the different plain forms."""
    found = [[(m.group().lower(), m.start(), m.end()) for m in LETTERS.finditer(t)] for t in batch] if len(lexicon.terms) else [[] for _ in batch]
    known = lexicon.look_up({w for words in found for w, _, _ in words})
    out = np.zeros((len(batch), 7))
    for row, text, words, label in zip(out, batch, found, labels or [None] * len(batch), strict=True):
        terms, plain = set(), set()
        for w, a, b in words:
            if (hit := known[w]) and not (hit[1] and forms.other(w, label)):
                inside = quoted(text, a, b)
                row[(2 if inside else 0) + (hit[1] > 0)] += 1
                if not inside:
                    plain.add(w)
                if hit[1] == 0:
                    terms.add(w)
        row[5] = 10 * row[:2].sum() / max(10, len(words))
        row[:4] = np.log1p(row[:4])
        row[4] = np.log1p(len(terms))
        row[6] = sum(forms.evidence(w, label) for w in sorted(plain)) / 4
    return out


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weights: np.ndarray
    forms: Forms = Forms({})

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def telling(own: DataFrame, parts: Callable[[str], list[str]], least_variety: int) -> list[Row]:
    """``part, t`` of the word parts that mark toxic documents: likely enough there, too much so for chance (the likelihood
    ratio against the share of toxic documents must outweigh the number of parts looked at), in company of different words before them,
    which parts from a family of copies are not, and in enough different words."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"label": batch.column("label"), "part": [], "before": [], "word": []}
        for text in batch.column("text").to_pylist():
            words = [w.lower() for w in LETTERS.findall(text)]
            first = {p: (words[k - 1] if k else "", w) for k, w in reversed(list(enumerate(words))) for p in parts(w)}
            out["part"].append(list(first))
            out["before"].append([x for x, _ in first.values()])
            out["word"].append([w for _, w in first.values()])
        return out

    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    bags = per_batch(own, "label int, part array<string>, before array<string>, word array<string>", work)
    each = bags.select("label", F.explode(F.arrays_zip("part", "before", "word")).alias("x")).select("label", "x.*")
    of_toxic = lambda c: F.count_distinct(F.when(F.col("label") == 1, F.col(c)))
    counts = stage(each.groupBy("part").agg(F.sum("label").alias("t"), F.count("*").alias("n"), of_toxic("before").alias("company"), of_toxic("word").alias("variety")))
    base, looked = toxic / (toxic + clean), counts.count()
    clear, share = F.col("n") - F.col("t"), F.col("t") / F.lit(toxic)
    ratio = F.col("t") * F.log(F.col("t") / (F.col("n") * base)) + F.when(clear > 0, clear * F.log(clear / (F.col("n") * (1 - base)))).otherwise(0.0)
    few = counts.filter((share / ((clear + 0.5) / (clean + 1.0)) >= LEAST_ODDS) & (ratio >= math.log(max(looked, 1)) + CAUTION))
    few = few.filter((2 * F.col("company") >= F.col("t")) & (F.col("variety") >= least_variety))
    return few.select("part", "t").orderBy("part").collect()  # each is in several documents of the bounded sample


def learn_terms(own: DataFrame) -> list[str]:
    """Words, and, from all other words, stems (written with an asterisk) that mark toxic documents.

    Of stems that continue each other the longest that is about as frequent as its beginnings stands for all."""
    words = {r.part for r in telling(own, lambda w: [w] if len(w) > 2 else [], 1)}
    found = {r.part: r.t for r in telling(own, lambda w: [] if w in words else [w[:k] for k in STEMS if k < len(w)], 3)}
    whole = [p for p, t in found.items() if not any(q[:-1] == p and 20 * u >= 19 * t for q, u in found.items())]
    stems = [p for p in whole if not any(p != q and p.startswith(q) for q in whole)]
    return sorted(words) + [p + "*" for p in sorted(stems)]


def learn_forms(own: DataFrame, terms: list[str]) -> Forms:
    """Counts of the terms and of the forms within one or two edits of one; they are words of the bounded sample."""
    hold: list[Lexicon] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not hold:
            hold.append(Lexicon(terms))
        bags = [{m.lower() for m in LETTERS.findall(t)} for t in batch.column("text").to_pylist()]
        known = hold[0].look_up(set().union(*bags))
        return {"label": batch.column("label"), "form": [[w for w in sorted(bag) if known[w]] for bag in bags]}

    near = per_batch(own, "label int, form array<string>", work).select("label", F.explode("form").alias("form"))
    met = near.groupBy("form").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")).collect()
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return Forms({r.form: (r.t, r.c) for r in met}, n.get(1, 0), n.get(0, 0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 1500) -> Model:
    own = stage(labelled(docs, labels, "toxic", sample))
    terms = learn_terms(own)
    forms = learn_forms(own, terms)
    rows = per_batch(own, "doc_id long, label int, x array<float>", lambda b, hold=[]: _figure_rows(b, terms, forms, hold)).collect()  # at most ``sample``
    rows.sort(key=lambda r: (r.doc_id, r.x))
    if not rows or not any(r.label for r in rows):
        return Model(terms, np.array([-30.0, 0, 0, 0, 0, 0, 0, 0]), forms)
    x, y = np.column_stack([np.ones(len(rows)), np.array([r.x for r in rows])]), np.array([r.label for r in rows], float)
    weights, m, v = np.zeros(8), np.zeros(8), np.zeros(8)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = (p - y) @ x / len(y) + 1e-4 * np.append(0, weights[1:])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weights -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(terms, weights, forms)


def _figure_rows(batch: pa.RecordBatch, terms: list[str], forms: Forms, hold: list) -> dict:
    if not hold:
        hold.append(Lexicon(terms))
    return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": list(figures(batch.column("text").to_pylist(), hold[0], forms, batch.column("label").to_pylist()))}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    hold: list[Lexicon] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not hold:
            hold.append(Lexicon(model.terms))
        return {"doc_id": batch.column("doc_id"), "score": model.score(figures(batch.column("text").to_pylist(), hold[0], model.forms))}

    scored = per_batch(texts(docs), "doc_id long, score double", work)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
