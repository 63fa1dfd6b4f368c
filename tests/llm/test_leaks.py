"""Benchmark leaks and the pipeline."""

import random

import numpy as np
from conftest_llm import odd_rows, prose, small_rows

import corpus_pipeline
from voltloom.llm import bpe, leaks, queries
from voltloom.llm.frame import ready

SMALL = "/root/testdata/sf0.001"


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for k, y in enumerate(text):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance():
    draw = random.Random(1)
    for _ in range(300):
        item = draw.choices(range(5), k=draw.randint(1, 80))
        text = draw.choices(range(5), k=draw.randint(0, 60))
        d, end = leaks.distance(item, text)
        assert d == least_distance(item, text) and (not end or d == least_distance(item, text[:end]))


def changed(draw, words, n):
    words = list(words)
    for _ in range(n):
        k = draw.randrange(len(words))
        words[k : k + draw.randint(0, 1)] = [prose(draw.randrange(10**6), 1)] * draw.randint(0, 1)
    return words


def test_recall_at_the_threshold():
    draw = random.Random(5)
    items = [prose(k, draw.randint(3, 70)) for k in range(150)]
    block = leaks.Items(list(range(150)), items)
    texts, wanted = [], []
    for k, item in enumerate(items):
        for share in (0, 0.5, 1):
            n = int(share * leaks.edits(len(item.split())))
            texts.append(" ".join([prose(1000 + k, 90), *changed(draw, item.split(), n), prose(2000 + k, 90)]))
            wanted.append(k)
    hashed = [leaks.hashed(t) for t in texts]
    found = {(t, i): d for t, i, d, *_ in block.hits(hashed)}
    right = [(t, k) for t, k in enumerate(wanted) if least_distance(block.words[k], hashed[t].tolist()) <= leaks.edits(len(block.words[k]))]
    assert np.mean([x in found for x in right]) >= 0.97
    assert all((t, k) in found for t, k in enumerate(wanted) if t % 3 == 0)
    assert all(d == least_distance(block.words[i], hashed[t].tolist()) for (t, i), d in found.items())


def test_query_leaks(spark):
    docs = {d["doc_id"]: leaks.hashed(d["text"]).tolist() for d in small_rows(spark)}
    items = {d["item_id"]: leaks.hashed(d["text"]).tolist() for d in small_rows(spark, "benchmark")}
    right = set()
    for d, text in docs.items():
        own = set(text)
        for i, item in items.items():
            if 2 * len(own & set(item)) >= len(set(item)) and least_distance(item, text) <= leaks.edits(len(item)):
                right.add((d, i))
    found = [(r.doc_id, r.item_id) for r in queries.op10_leaks(spark, SMALL).collect()]
    assert right and len(found) == len(set(found)) and set(found) == right


def test_odd_leaks(spark, odd, nothing, monkeypatch):
    ready(spark)
    rows = [(1, prose(1, 25), "x"), (2, None, "x"), (None, "a b c d", "x"), (3, "", "x"), (4, "two words", "x"), (5, prose(77, 20), "x"), (1, prose(1, 25), "x")]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    found = leaks.leaks(odd, items).collect()
    assert {r.item_id for r in found} == {1} and {r.doc_id for r in found} == {1, 2, 7, 14}
    kept = leaks.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) - len(found)
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert sorted(leaks.leaks(odd, items).collect()) == sorted(found)
    assert leaks.leaks(nothing, items).count() == leaks.leaks(odd, items.limit(0)).count() == 0


def test_pipeline(spark):
    kept, last = None, spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        kept, last = last, step(spark, last, SMALL).cache()
        assert name == "token ids" or last.columns == kept.columns
    rows = {r.doc_id: r for r in last.collect()}
    docs = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == set(docs) and len(rows) > 100
    t = bpe.load(queries.public_tokenizers.path("byte_bpe_50k.json"))[0]
    for i, r in rows.items():
        assert b"".join(t.label[x] for x in np.frombuffer(r.ids, "<u4").tolist()).decode() == docs[i]
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {i: r.ids_sha256 for i, r in rows.items()}


def test_odd_rows_pass_through(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SMALL)
            if name != "token ids":
                assert docs.columns == odd.columns
        docs.collect()
