"""Token ids as grammar-compressed files (Re-Pair), with random-access decoding.

Documents are dealt by ascending ``doc_id`` (ties by text) over shards, tokenized with a vocabulary file of the ``tokenizers`` library, and
gathered into blocks of about ``BLOCK`` ids; a block ends with a document, so a longer document is a block of its own. In each block the
most frequent pairs of neighbouring symbols become nonterminals, round after round: a position is replaced where its pair is more frequent
than the pairs it overlaps, and a pair becomes a rule if at least ``MIN_PAIRS`` of its positions are.

A file row holds: ``shard, block, start`` (ids of the shard before it), ``n_ids``, ``terminals`` (the first nonterminal), ``rules`` (left and
right symbol of each), ``lengths`` (ids that each rule expands to), ``body`` (the remaining symbols), ``docs`` and ``sizes`` (documents and
their numbers of ids), all little-endian. The folder is Parquet, so a lost task leaves no half block.

Defined results: a null or empty text has only the end id; null ``doc_id`` comes first; repeated rows are kept as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltloom.llm.bpe import byte_letters
from voltloom.llm.frame import arrow_schema, texts

BLOCK = 1 << 19
MIN_PAIRS = 8
#: A round that shortens a block by less than this share is the last.
LEAST_GAIN = 0.01
#: Pieces a worker remembers before it starts anew; this bounds memory only.
REMEMBERED = 400_000
#: Words whose tokens are held as objects of the library at once.
AT_ONCE = 4096
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: ASCII punctuation.
BEHIND = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
NO_ID = np.iinfo(np.int64).min
FILE = (
    "shard int, block int, start long, n_ids long, terminals int, rules binary, lengths binary, body binary, docs binary, sizes binary"
)


def compress(ids: np.ndarray, terminals: int, least: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rules, lengths, body)``: rule k makes symbol ``terminals + k`` from its two symbols and expands to ``lengths[k]`` ids."""
    body = ids.astype(np.int64)
    rules, lengths = np.zeros((0, 2), np.int64), np.ones(0, np.int64)
    while len(body) > 1:
        pair = body[:-1] << 32 | body[1:]
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        often = np.bincount(slot, minlength=1 << 20)[slot]
        weight = np.full(len(pair) + 2, -1)
        weight[1:-1] = often << 20 | slot  # alike for alike pairs
        at = np.flatnonzero((weight[1:-1] > weight[:-2]) & (weight[1:-1] >= weight[2:]))
        at = at[often[at] >= least]
        chosen = np.sort(pair[at])
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)])
        made = chosen[first][np.diff(np.append(first, len(chosen))) >= least]
        if not len(made):
            break
        rule = np.minimum(np.searchsorted(made, pair[at]), len(made) - 1)
        kept = made[rule] == pair[at]
        at, rule = at[kept], rule[kept]
        size = lambda s: np.where(s < terminals, 1, lengths[np.maximum(s - terminals, 0)] if len(lengths) else 1)
        left, right = made >> 32, made & 0xFFFFFFFF
        body[at] = terminals + len(rules) + rule
        lengths = np.append(lengths, size(left) + size(right))
        rules = np.vstack([rules, np.stack([left, right], 1)])
        before = len(body)
        body = np.delete(body, at + 1)
        if before - len(body) < LEAST_GAIN * before:
            break
    return rules, lengths, body


def expand(rules: np.ndarray, body: np.ndarray, terminals: int) -> np.ndarray:
    """All ids: each pass replaces every nonterminal by its two symbols."""
    body = body.astype(np.int64)
    while len(body):
        whole = body >= terminals
        if not whole.any():
            break
        rule = body[whole] - terminals
        place = np.cumsum(whole) - whole + np.arange(len(body))
        out = np.empty(len(body) + len(rule), np.int64)
        out[place] = body
        out[place[whole]], out[place[whole] + 1] = rules[rule, 0], rules[rule, 1]
        body = out
    return body


def access(rules: np.ndarray, lengths: np.ndarray, body: np.ndarray, terminals: int, low: int, high: int) -> np.ndarray:
    """Ids ``low`` to ``high`` (exclusive) of a block. Expansion lengths lead to the symbols that cover them; only these are expanded."""
    size = np.where(body < terminals, 1, lengths[np.maximum(body - terminals, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
    begin = ends[first] - size[first] if first < len(ends) else low
    return expand(rules, body[first : last + 1], terminals)[low - begin : high - begin]


class Rows:
    """Ids of numbered things, in one row."""

    def __init__(self):
        self.ids, self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these, in a row, and how many each has."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + size, size)], size


class Pieces:
    """Ids of the pieces between white space met so far.

    The file's splitter drops white space and never joins across it. A piece of Latin letters with ASCII punctuation behind is two words to
    it; such words go to the library's model without normalizer and splitter; all other pieces go through everything. Pieces are split and
    told apart by Arrow, at ASCII white space; only those that differ within a batch are looked up.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.pieces, self.parts = Rows(), Rows()
        self.parts.add(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def learn(self, new: list[str]) -> np.ndarray:
        """Numbers of pieces not met so far."""
        words, before, pairs, odd = self.words, len(self.words), [], []
        number = words.setdefault
        for piece in new:
            word = piece if piece.isalpha() else piece.rstrip(BEHIND)
            if word.isalpha() and (word.isascii() or LATIN.fullmatch(word)):
                pairs += number(word.lower(), len(words)), number(piece[len(word) :], len(words))
            else:
                pairs += 0, 0
                odd.append(len(pairs) // 2 - 1)
        fresh, ids, size = list(islice(words, before, None)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(fresh), AT_ONCE):
            own = fresh[k : k + AT_ONCE]
            tokens = [self.model.tokenize(w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))) for w in own]
            ids.append(np.array([t.id for parts in tokens for t in parts], np.int64))
            size.append(np.fromiter(map(len, tokens), np.int64, len(own)))
        self.parts.add(np.concatenate(ids), np.concatenate(size))
        ids, size = self.parts.take(np.array(pairs, np.int64))
        size = size.reshape(-1, 2).sum(1)
        whole = np.ones(len(new), bool)
        whole[odd] = False
        self.pieces.add(ids, size[whole])
        encoded = self.tokenizer.encode_batch_fast([new[k] for k in odd], add_special_tokens=False)
        self.pieces.add(np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64), np.array([len(e.ids) for e in encoded], np.int64))
        numbers = np.empty(len(new), np.int64)
        numbers[[*np.flatnonzero(whole).tolist(), *odd]] = len(self.number) + np.arange(len(new))
        self.number.update(zip(new, numbers.tolist(), strict=True))
        return numbers

    def tokenize(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = pc.dictionary_encode(split.flatten())
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        own = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(own < 0)
        own[new] = self.learn([pieces[k] for k in new.tolist()])
        ids, size = self.pieces.take(own[coded.indices.to_numpy()])
        borders = np.append(0, np.cumsum(size))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(borders, borders[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def write(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Tokenize, append ``end_id`` to each document and write the blocks to the folder ``path``."""
    schema = arrow_schema(FILE)
    ordered = texts(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, blocks = TaskContext.get().partitionId(), 0, 0
        terminals = max(load(vocabulary).terminals, end_id + 1)
        held: list[np.ndarray] = []
        names: list[int] = []
        total = 0

        def block() -> pa.RecordBatch:
            rules, lengths, body = compress(np.concatenate(held), terminals)
            row = {
                "shard": shard, "block": blocks, "start": done, "n_ids": total, "terminals": terminals, "rules": rules.astype("<u4").tobytes(),
                "lengths": lengths.astype("<u4").tobytes(), "body": body.astype("<u4").tobytes(), "docs": np.array(names, "<i8").tobytes(),
                "sizes": np.array([len(x) for x in held], "<u4").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids = load(vocabulary).tokenize(batch.column("text"))
            for name, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                held.append(np.append(own, end_id))
                names.append(NO_ID if name is None else name)
                total += len(own) + 1
                if total >= BLOCK:
                    yield block()
                    done, blocks, total, held, names = done + total, blocks + 1, 0, [], []
        if held:
            yield block()

    ordered.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    return rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["body"], "<u4").astype(np.int64), row["terminals"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files: ``start`` counts the ids of all documents before."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("own"))  # a row a shard, and shards are at most the shuffle's partitions
    before = shards.select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("base"))
    ddl = "doc_id long, start long, n_tokens long, ids binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rules, body = (np.frombuffer(row[x], "<u4").astype(np.int64) for x in ("rules", "body"))
                data = expand(rules.reshape(-1, 2), body, row["terminals"]).astype("<u4").tobytes()
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                names = np.frombuffer(row["docs"], "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, mask=names == NO_ID), pa.array(starts + row["base"] + row["start"]), pa.array(sizes),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], schema=schema)

    return blocks.join(F.broadcast(before), "shard").select("base", "start", "terminals", "rules", "body", "docs", "sizes").mapInArrow(run, ddl)
