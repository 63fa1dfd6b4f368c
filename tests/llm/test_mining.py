"""Hard negatives, the Merkle manifest and the fingerprint exchange against brute force."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from conftest_llm import SMALL, small_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm import exchange, manifest, negatives, queries

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("leaf", T.StringType()), T.StructField("vec", T.StringType()), T.StructField("salt", T.StringType()),
])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


# hard negatives


def brute_negatives(rows):
    best = {}
    for r in rows:
        v = r[1]
        if r[0] is None or r[2] is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (r[2] if r[0] % 7 else (r[2] + 1) % 10, [int(np.floor(float(np.float32(x)) * 256)) for x in v])
        best[r[0]] = min(best.get(r[0], one), one)
    out = []
    for a in best:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(best[a][1], best[b][1])), b) for b in best if b != a)
        for ps, p in [(-s, b) for s, b in scored if best[b][0] == best[a][0]][:5]:
            inside = [(-s, b) for s, b in scored if best[b][0] != best[a][0] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k + 1, b, ps, s) for k, (s, b) in enumerate(inside)]
    return sorted(out)


def mine(spark, rows):
    df = spark.createDataFrame([(*r, None, "x", "y") for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mined(negatives.known(df, label)).collect())


def test_query_negatives(spark):
    own = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SMALL).collect())
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in small_rows(spark, "embeddings")]
    assert own == brute_negatives(rows) and len(own) == 150


def test_negatives_with_clusters_ties_and_odd_rows(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.05 * draw.normal(size=12)).tolist(), int(draw.integers(0, 4))) for i in range(1200)]
    rows += [(2000 + i, centres[0].tolist(), i % 2) for i in range(700)]  # one vector, many times
    rows += [(2050, [0.5] * 12, 3), (2050, [0.5] * 12, 3), (5000, None, 1), (5050, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(5100, [float("nan")] * 12, 1), (5150, [float("inf")] + [0.0] * 11, 2), (5200, [None] * 12, 1), (5250, [], 1), (5300, [0.3] * 5, 2), (-50, [-1.0] * 12, 0)]
    assert mine(spark, rows) == brute_negatives(rows)


def test_negatives_leave_subtrees_out(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 16)) * 2
    rows = [(i, (centres[i % 40] + 0.02 * draw.normal(size=16)).tolist(), int(draw.integers(0, 3))) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    known = negatives.known(df, F.col("label")).cache()
    tree = negatives.fit(known)
    placed = negatives.placed(known, tree).cache()
    tree = negatives.with_ranges(tree, placed)
    some = placed.limit(64).toPandas()
    vecs = np.array(some["vec"].tolist(), float)
    near = ((vecs**2).sum(axis=1) * 0.98)[:, None]
    asked = negatives.visited(tree, vecs, near, np.full_like(near, np.inf))
    assert tree.leaves > 40 and sum(map(len, asked.values())) < 0.2 * 64 * tree.leaves
    where = dict(placed.select("vec_id", "leaf").collect())
    data = {r.vec_id: np.array(r.vec, float) for r in placed.collect()}
    for k, v in enumerate(vecs):  # no row of a window stands in a leaf that was left out
        assert all(k in asked[where[i]] for i, x in data.items() if v @ x >= near[k, 0])


def test_negatives_of_few_or_no_rows(spark):
    assert mine(spark, []) == [] and mine(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mine(spark, [(0, [1.0], 0), (1, [1.0], 1), (2, [0.6], 2)]) == [(0, 1, 1, 2, 65536, 153 * 256)]


# the manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    def leaf(r, text):
        return digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def levels(low):
        out = [low]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[k] = levels([leaf(r, r["text"]) for r in groups[k]])
    top, out = levels([trees[k][-1][0] for k in names]), []
    for n, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            own, proof = leaf(r, text), []
            for tree, at in ((trees[k], i), (top, n)):
                for level in tree[:-1]:
                    a, b = level[at // 3 * 3 : at], level[at + 1 : at // 3 * 3 + 3]
                    proof, own, at = proof + a + b, digest("".join([*a, own, *b])), at // 3
            root = top[-1][0]
            out.append((str(r["doc_id"]), leaf(r, r["text"]), trees[k][-1][0], root, digest("".join(proof)), own, own == root))
    return sorted(out)


def proven(df):
    return sorted((str(r[0]), *r[1:]) for r in manifest.manifest(df, manifest.without_newlines()).collect())


def test_query_manifest(spark):
    own = sorted((str(r[0]), *r[1:]) for r in queries.op12_merkle_manifest(spark, SMALL).collect())
    assert own == brute_manifest(small_rows(spark))


def test_manifest_of_odd_rows(spark, odd, nothing):
    draw = random.Random(4)
    odd = odd.withColumn("source", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else 'é' end")).withColumn("key", F.lit(1)).withColumn("level", F.lit(2))
    assert proven(odd) == brute_manifest([r.asDict() for r in odd.collect()])
    assert proven(nothing) == []
    rows = [(i, f"{i}\n{draw.random()}", None, f"s{i % 800}" if i % 3 else "hot", i) for i in range(2600)]  # two bands of leaves, two of sources
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert proven(docs) == brute_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 729, 730])
def test_nodes_cover_intervals(spark, n):
    leaves = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    bands, roots = manifest.tree(leaves)
    nodes = {(r.level, r.low, r.high): r.digest for b in bands for r in b.collect()}
    level, at = 0, [(k, k + 1) for k in range(n)]
    while True:
        assert sorted(x[1:] for x in nodes if x[0] == level) == at
        if len(at) == 1:
            break
        level, at = level + 1, [(at[k][0], at[min(k + 2, len(at) - 1)][1]) for k in range(0, len(at), 3)]
    assert roots.collect()[0].digest == nodes[level, 0, n]


# exact duplicates


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r["text"]), []).append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        out += [(str(i), str(ids[0]), len(ids), k == 0, digest(text)) for k, i in enumerate(ids)]
    return sorted(out)


def exact(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exchange.exact_duplicates(df).collect())


def test_query_exact(spark):
    own = queries.op13_exact_exchange(spark, SMALL).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in own) == brute_exact(small_rows(spark))


@pytest.mark.parametrize("shown", [2_000_000, 0])
def test_exact_of_odd_rows(spark, odd, nothing, monkeypatch, shown):
    monkeypatch.setattr(exchange, "SHOWN", shown)
    odd = odd.withColumn("sha", F.lit(1)).withColumn("keep_id", F.lit("x"))
    more = odd.union(odd.filter("doc_id in (1, 3)").withColumn("text", F.upper("text"))).union(odd.filter("doc_id is null"))
    assert exact(more) == brute_exact([r.asDict() for r in more.collect()])
    assert exact(nothing) == []


def test_exact_with_a_hot_group(spark):
    rows = [(i, "Hot Text" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"own {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert exact(docs) == brute_exact([r.asDict() for r in docs.collect()])


def test_golomb_round_trip():
    draw = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 2**40), (1000, 1001), (5000, 2**30), (3, 2**53)):
        values = np.unique(draw.integers(0, top, n).astype(np.uint64))
        low, code = exchange.golomb(values)
        assert (exchange.opened(len(values), low, code) == values).all()
    values = np.unique(draw.integers(0, 2**30, 10000).astype(np.uint64))
    assert len(exchange.golomb(values)[1]) * 8 < 20 * len(values)  # about log2(2**30 / 10000) + 1.5 bits
