"""Ids by automaton and by grammar against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_rows, small_rows
from tokenizers import Tokenizer

from voltloom.llm import bpe, queries, repair
from voltloom.llm.frame import ready

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n=3000):
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x2028, 0x3000, 0x200B, 0x1F600, 0x85, 0xA0]]
    return ["".join(draw.choices(draw.choice([letters, "ab cde'stre  \n\tAE.É|ß", "aab  "]), k=draw.randint(0, 40))) for _ in range(n)]


def test_automaton_is_the_library():
    texts = random_texts() + [r[1] or "" for r in odd_rows()] + ["=" * 200 + "\n" * 50, "<|endoftext|>" * 3]
    own = bpe.encode_texts(texts, BYTE)
    for text, ids, right in zip(texts, own, library(BYTE).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == right.ids, text


def test_gadgets_cut_arcs():
    vocab = {"a": 0, "b": 1, "ab": 2, "aa": 3, "aab": 4}
    automaton = bpe.Automaton(vocab, [["a", "b"], ["a", "a"], ["a", "ab"]], {})
    assert [automaton.encode([w])[0] for w in (b"aab", b"aaab", b"aaa", b"abab", b"")] == [[4], [3, 2], [3, 0], [2, 2], []]


def test_pieces_are_the_library():
    texts = random_texts() + [r[1] or "" for r in odd_rows()]
    own = repair.Pieces(WORD).tokenize(texts)
    for text, ids, right in zip(texts, own, library(WORD).encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == right.ids, text


def test_pieces_of_a_batch_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own = repair.Pieces(WORD)
    own.number = Counted()
    texts = ["the cat, the CAT\tand \x0bthe dog ", "", " \n "] * 500
    ids = own.tokenize(texts)
    assert own.number.asked <= 8
    assert [x.tolist() for x in ids] == [e.ids for e in library(WORD).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("ids", [[], [3], [5, 5, 5, 5, 5, 5, 5], [1, 2] * 50, list(range(40))])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.int64)
    rules, lengths, body = repair.compress(ids, 100, least=2)
    assert repair.expand(rules, body, 100).tolist() == ids.tolist()


def test_random_access():
    draw = np.random.default_rng(2)
    ids = np.concatenate([np.tile(draw.integers(0, 50, 30), 20), draw.integers(0, 50, 500)])
    rules, lengths, body = repair.compress(ids, 50, least=2)
    assert len(rules) and len(body) < len(ids)
    for low, high in ((0, 0), (0, len(ids)), (17, 18), (100, 333), (599, 800), (len(ids) - 1, len(ids))):
        assert repair.access(rules, lengths, body, 50, low, high).tolist() == ids[low:high].tolist()


def test_query_repair(spark):
    docs, start = sorted(small_rows(spark), key=lambda r: r["doc_id"]), 0
    own = {r.doc_id: r for r in queries.op1_repair_tokens(spark, SMALL).collect()}
    for doc, e in zip(docs, library(WORD).encode_batch([d["text"] for d in docs], add_special_tokens=False), strict=True):
        ids, r = np.array([*e.ids, 2], "<u4"), own[doc["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query_bpe(spark):
    docs = small_rows(spark)
    own = {r.doc_id: r for r in queries.op5_bpe_automaton(spark, SMALL).collect()}
    t = library(BYTE)
    for doc, e in zip(docs, t.encode_batch([d["text"] for d in docs], add_special_tokens=False), strict=True):
        r = own[doc["doc_id"]]
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(e.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, odd, nothing, tmp_path):
    for docs, n in ((odd, len(odd_rows())), (nothing, 0)):
        rows = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
        assert len(rows) == n
        assert sorted(r.text for r in rows) == sorted((r[1] or "") for r in odd_rows()[:n])
        path = str(tmp_path / f"ids{n}")
        repair.write(docs, WORD, 2, path)
        rows = sorted(repair.read(ready(spark), path).collect(), key=lambda r: r.start)
        assert len(rows) == n and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:n].tolist()
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
