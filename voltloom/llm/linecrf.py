"""Content or boilerplate: a linear-chain conditional random field over the lines of a document.

Each line has a few yes/no features; the field has a weight for each feature and label and for each pair of neighbouring labels. It is
trained on lines of labelled documents (at most ``SAMPLE``): the lines of a document marked good count as content, those of a bad one as
boilerplate, and what both kinds of document have in common stays content because most lines are. Viterbi decoding labels the lines;
a document is kept if content lines hold at least ``SHARE`` of its word characters.

Base figures per document follow the same pass: words, word characters, symbols, repeated lines, words in repeated three-word windows.

Defined results: a null or empty text has zeros and fails the base rule; repeated rows are judged alike; without labels every document
that passes the base rule is kept; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltloom.llm.folds import labelled
from voltloom.llm.frame import WORD, per_batch, texts

#: Most labelled documents the field is trained on.
SAMPLE = 3000
#: Lines of one training sequence; a longer document gives several.
CHAIN = 64
SHARE = 0.4
FEATURES = 14
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def line_features(lines: list[str]) -> tuple[list[int], list[int]]:
    """Feature bits and word characters of each line."""
    seen: set[str] = set()
    bits, sizes = [], []
    for line in lines:
        words = WORD.findall(line)
        n, chars = len(words), sum(map(len, words))
        symbols = len(line) - len(line.translate(SYMBOLS))
        last = words[-1][-1] if n else ""
        found = (
            n == 0, 0 < n <= 2, 2 < n <= 6, n > 30, last in ".!?…", last in ":;,-", symbols > 0, 20 * symbols > chars, "|" in line,
            n > 0 and 2 * sum(w.isupper() for w in words) > n, 4 * sum(map(str.isdigit, line)) > chars > 0, line in seen and n > 0,
            n > 5 and 2 * len(set(words)) < n, 3 * line.count("!") > n > 0,
        )
        bits.append(sum(1 << k for k, x in enumerate(found) if x))
        sizes.append(chars)
        seen.add(line)
    return bits, sizes


def spread(bits: np.ndarray) -> np.ndarray:
    """Feature bits as columns, with a constant first."""
    return np.concatenate([np.ones((*bits.shape, 1)), (bits[..., None] >> np.arange(FEATURES) & 1)], -1).astype(float)


def train(chains: list[tuple[list[int], int]], rounds: int = 120, rate: float = 0.15) -> np.ndarray:
    """Weights: per feature the score of content over boilerplate, then the four scores of neighbouring labels."""
    weights = np.zeros(1 + FEATURES + 4)
    pieces = [(b[k : k + CHAIN], y) for b, y in chains for k in range(0, len(b), CHAIN)]
    if not pieces or len({y for _, y in pieces}) < 2:
        weights[0] = 4.0
        return weights
    n, longest = len(pieces), max(len(b) for b, _ in pieces)
    bits, there, truth = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    for k, (b, y) in enumerate(pieces):
        bits[k, : len(b)], there[k, : len(b)], truth[k, : len(b)] = b, True, y
    x = spread(bits)
    both = there[:, 1:]
    real = np.zeros(4)
    np.add.at(real, (2 * truth[:, :-1] + truth[:, 1:])[both], 1)
    real = np.append(np.einsum("nlf,nl->f", x, (truth * there).astype(float)), real)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        edge = weights[-4:].reshape(2, 2)
        own = np.stack([np.zeros((n, longest)), x @ weights[:-4]], -1)
        ahead, after = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = own[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(there[:, t, None], own[:, t] + np.logaddexp(ahead[:, t - 1, :1] + edge[0], ahead[:, t - 1, 1:] + edge[1]), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = own[:, t + 1] + after[:, t + 1]
            after[:, t] = np.where(there[:, t + 1, None], np.logaddexp(edge[:, 0] + nxt[:, :1], edge[:, 1] + nxt[:, 1:]), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        content = np.exp(ahead[..., 1] + after[..., 1] - total[:, None]) * there
        pairs = np.exp(ahead[:, :-1, :, None] + edge + (own + after)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        gradient = (real - np.append(np.einsum("nlf,nl->f", x, content), pairs.sum((0, 1)).ravel())) / n - 1e-3 * weights
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def viterbi(bits: list[int], weights: np.ndarray) -> list[int]:
    """Best labels of the lines: 1 is content."""
    own = (spread(np.array(bits, np.int64)) @ weights[:-4]).tolist()
    e00, e01, e10, e11 = weights[-4:].tolist()
    back, a, b = [], 0.0, own[0]
    for score in own[1:]:
        to0, to1 = a + e00 >= b + e10, a + e01 > b + e11
        back.append((0 if to0 else 1, 0 if to1 else 1))
        a, b = (a + e00 if to0 else b + e10), (a + e01 if to1 else b + e11) + score
    at, out = int(b >= a), []
    for step in reversed(back):
        out.append(at)
        at = step[at]
    return [at, *out[::-1]] if own else []


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more. Words become numbers of this text, so equal windows are equal triples."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    order = np.argsort(pair, kind="stable")
    rank = np.empty(n - 1, np.int64)
    rank[order] = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1]))
    triple = rank[:-1] * len(number) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    def work(batch: pa.RecordBatch) -> dict:
        bits = [line_features(t.split("\n"))[0] for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bits": bits}

    own = labelled(docs, labels, "quality", sample)
    rows = per_batch(own, "doc_id long, label int, bits array<int>", work).collect()  # at most ``sample`` documents' line bits
    return train([(r.bits, int(r.label > 0)) for r in sorted(rows, key=lambda r: (r.doc_id, r.bits)) if r.bits])


def judge(docs: DataFrame, weights: np.ndarray, share: float = SHARE) -> DataFrame:
    """``doc_id``, base figures, ``base_failed``, ``content_share``, ``labels`` (of the lines) and ``kept``."""
    ddl = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "content_share double, labels array<int>, kept boolean"
    )

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {x.split(" ")[0]: [] for x in ddl.split(", ")}
        out["doc_id"] = batch.column("doc_id")
        for text in batch.column("text").to_pylist():
            words = WORD.findall(text)
            lines = text.split("\n")
            worded = [x for x in lines if WORD.search(x)]
            n, repeats = len(words), repeated_words(words)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
            bits, sizes = line_features(lines)
            found = viterbi(bits, weights)
            content = sum(s for s, y in zip(sizes, found, strict=True) if y) / max(1, sum(sizes))
            row = (n, sum(map(len, words)), len(text) - len(text.translate(SYMBOLS)), len(worded) - len(set(worded)), repeats, failed, content, found)
            for name, value in zip(list(out)[1:], (*row, not failed and content >= share), strict=True):
                out[name].append(value)
        return out

    return per_batch(texts(docs), ddl, work)
