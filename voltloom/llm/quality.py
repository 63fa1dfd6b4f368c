"""Quality by positive-unlabelled learning.

Trusted positives are rows marked good; the unlabelled set is a sample of all documents. A linear model on byte frequencies and a few
repetition figures minimises the non-negative unbiased risk  prior * E_p[l(x, 1)] + max(0, E_u[l(x, 0)] - prior * E_p[l(x, 0)]):
what the unlabelled rows hold as negatives after the positives' share is taken away never counts below zero. The prior is the share
of good rows among the labelled ones. At most ``SAMPLE`` labelled and as many unlabelled rows are used; held-out rows never are.

Defined results: a null or empty text is scored like any other by its (zero) figures; without labels every score is the prior's
default; repeated rows get the same score; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.folds import held_out, labelled, unlabelled
from voltloom.llm.frame import keep_rows, per_batch, texts

SAMPLE = 8000
THRESHOLD = 0.3
EXTRA = 9


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.sqrt(np.bincount(raw, minlength=256) / max(1, len(raw)))
    words = text.split()
    n, lines = max(1, len(words)), [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words)) / n
    ends = sum(w[-1] in ".!?" for w in words) / n
    again = sum(map(str.__eq__, words, words[1:])) / n
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)
    barred = sum(not any(map(str.isalnum, w)) for w in words) / n
    more = [
        again, min(1.0, triples), barred, upper, ends, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10, np.log1p(len(raw) / n) / 5,
    ]
    return np.concatenate([share, more]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unmarked: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.03, keep: float = 1e-4) -> Model:
    dims = 256 + EXTRA
    if not len(positive) or not len(unmarked):
        return Model(np.zeros(dims), np.ones(dims), np.append(np.log(prior / (1 - prior)), np.zeros(dims)), prior)
    middle, spread = unmarked.mean(0), unmarked.std(0) + 1e-3
    p, u = (np.column_stack([np.ones(len(x)), np.clip((x - middle) / spread, -8, 8)]) for x in (positive, unmarked))
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, rounds + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        gradient = prior * ((sp - 1) @ p) / len(p) + negative if rest >= 0 else -negative
        gradient = gradient + keep * np.append(0, w[1:])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(middle, spread, w, prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def work(batch: pa.RecordBatch) -> dict:
        rows = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": [features(t).tobytes() for t in rows]}

    ddl = "doc_id long, label int, x binary"
    marked = per_batch(labelled(docs, labels, "quality", sample), ddl, work)
    other = per_batch(unlabelled(docs, sample).withColumn("label", F.lit(-1)), ddl, work)
    rows = sorted(marked.unionByName(other).collect(), key=lambda r: (r.doc_id, r.label, r.x))  # at most twice ``sample`` rows
    shares = [r.label > 0 for r in rows if r.label >= 0]
    prior = min(0.98, max(0.02, float(np.mean(shares)))) if shares else 0.5
    take = lambda ok: np.frombuffer(b"".join(r.x for r in rows if ok(r.label)), np.float32).astype(float).reshape(-1, 256 + EXTRA)
    return train(take(lambda y: y > 0), take(lambda y: y < 0), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        x = np.stack([features(t) for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "score": model.score(x)}

    scored = per_batch(texts(docs), "doc_id long, score double", work)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, whole, that score at least the threshold."""
    return keep_rows(docs, lambda batch: model.score(np.stack([features(t) for t in batch.column("text").to_pylist()])) >= THRESHOLD)
