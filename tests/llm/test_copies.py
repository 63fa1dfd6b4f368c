"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from conftest_llm import odd_rows, prose, small_rows

from voltloom.llm import anchors, fmindex, queries, simhash, suffix
from voltloom.llm.components import components

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def print_of(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_roots(prints):
    pairs = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 3]
    return roots(pairs, {i for i, _ in prints})


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    own = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    right = roots(edges, {x for e in edges for x in e})
    alone = {i for i in right if all(a == b for a, b in edges if i in (a, b))}
    assert own == {i: r for i, r in right.items() if i not in alone}


@pytest.mark.parametrize("crowd", [512, 3])
def test_links_keep_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(crowd)
    prints = []
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.append(x)
    prints = list(enumerate(sorted(set(prints) | {0, 1 << 63, (1 << 64) - 1})))
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints]
    found = simhash.links(spark.createDataFrame(rows, "id long, fp long")).collect()
    assert all((prints[a][1] ^ prints[b][1]).bit_count() <= 3 for a, b in found)
    assert roots(found, dict(prints)) == near_roots(prints)


def test_query_simhash(spark):
    docs = small_rows(spark)
    own = {r.doc_id: r for r in queries.op2_simhash(spark, SMALL).collect()}
    prints = [(d["doc_id"], print_of(d["text"])) for d in docs]
    assert {i: r.fingerprint for i, r in own.items()} == {i: f"{x:016x}" for i, x in prints}
    assert {i: r.component_id for i, r in own.items()} == near_roots(prints)


def test_odd_simhash(spark, odd, nothing):
    own = simhash.near_duplicates(odd).collect()
    assert len(own) == len(odd_rows()) and simhash.near_duplicates(nothing).count() == 0
    of = {r.doc_id: r.component_id for r in own}
    assert of[2] == 1 and of[3] == of[4] == of[5] == 3 and of[None] is None and of[2**62] == -5
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted(str(r.doc_id) for r in stay.collect() if r.doc_id is None or r.doc_id < 6) == ["-5", "1", "3", "None", "None"]


def words_left(docs, window):
    """(id, text) in order -> words, words removed, words that stay."""
    seen, out = set(), []
    for text in docs:
        words, gone = WORD.findall(text or ""), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def bytes_left(texts, window):
    counts: dict = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for s in range(len(b) - window + 1):
            counts[b[s : s + window]] = counts.get(b[s : s + window], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                gone[s : s + window] = True
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_query_fm_index(spark):
    docs = sorted(small_rows(spark), key=lambda d: d["doc_id"])
    own = {r.doc_id: r for r in queries.op3_fm_index(spark, SMALL).collect()}
    for doc, (n, gone, left) in zip(docs, words_left([d["text"] for d in docs], 20), strict=True):
        r = own[doc["doc_id"]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(left.encode()).hexdigest())


def test_query_suffix_array(spark):
    docs = sorted(small_rows(spark), key=lambda d: d["doc_id"])
    own = {r.doc_id: r for r in queries.op6_suffix_array(spark, SMALL).collect()}
    for doc, (n, gone, spans, left) in zip(docs, bytes_left([d["text"] for d in docs], 200), strict=True):
        r = own[doc["doc_id"]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(left).hexdigest())


def documents():
    """Odd rows as documents: rows that repeat id and text are one; order by id, then by Spark's hash of the text."""
    return list(dict.fromkeys((i, t or "") for i, t, *_ in odd_rows() if i is not None and i != 12))


@pytest.mark.parametrize("crowd", [anchors.CROWD, 1])
def test_odd_rows(spark, odd, nothing, crowd):
    known = odd.filter("doc_id is not null and doc_id <> 12")
    docs = sorted(documents(), key=lambda d: d[0])
    own = {r.doc_id: r for r in fmindex.remove_repeats(known, crowd=crowd).collect()}
    for (i, _), (n, gone, left) in zip(docs, words_left([t for _, t in docs], 20), strict=True):
        assert (own[i].n_words, own[i].n_removed, own[i].kept) == (n, gone, left), i
    own = {r.doc_id: r for r in suffix.remove_repeats(known, crowd=crowd).collect()}
    for (i, _), (n, gone, spans, left) in zip(docs, bytes_left([t for _, t in docs], 200), strict=True):
        assert (own[i].n_bytes, own[i].n_removed, own[i].n_spans, own[i].kept) == (n, gone, spans, left), i
    assert fmindex.remove_repeats(nothing).count() == suffix.remove_repeats(nothing).count() == 0


def test_all_rows_come_back(odd):
    assert fmindex.remove_repeats(odd).count() == suffix.remove_repeats(odd).count() == len(odd_rows())
    cut = fmindex.shortened(odd)
    assert cut.columns == odd.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[2] == "" and texts[5] == " \n\t " and texts[3] is None and texts[1] == odd_rows()[0][1]


def many(seed, alphabet, n):
    draw = random.Random(seed)
    base = [bytes(draw.choices(alphabet, k=draw.randint(80, 200))) for _ in range(6)]
    return [b"".join(draw.choices(base, k=draw.randint(3, 6))) + bytes(draw.choices(alphabet, k=60)) for _ in range(n)]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", b"a"])
def test_suffix_blocks(monkeypatch, alphabet):
    """Long ties, and buckets of a few suffixes."""
    monkeypatch.setattr(suffix, "BUCKET", 16)
    units = many(len(alphabet), alphabet, 12)
    n = np.array([len(u) - 99 for u in units])
    own = suffix.elsewhere(units, n, np.zeros(len(units), bool), 100)
    windows = [u[k : k + 100] for u in units for k in range(len(u) - 99)]
    counts: dict = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    assert own.tolist() == [counts[w] > 1 for w in windows]


@pytest.mark.parametrize("vocabulary", [1, 2, 30])
def test_backward_search(vocabulary):
    draw = np.random.default_rng(vocabulary)
    passage = draw.integers(0, vocabulary, 40).astype(np.uint64)
    units = [np.concatenate([draw.integers(0, vocabulary, draw.integers(1, 30)).astype(np.uint64), passage[draw.integers(0, 9) :]]) for _ in range(15)]
    n = np.array([len(u) - 11 for u in units])
    own = fmindex.earlier([u.tobytes() for u in units], n, np.zeros(15, bool), 12)
    seen, right = set(), []
    for u in units:
        for k in range(len(u) - 11):
            key = u[k : k + 12].tobytes()
            right.append(key in seen)
            seen.add(key)
    assert own.tolist() == right


def test_wavelet_ranks():
    draw = np.random.default_rng(4)
    sequence = draw.integers(0, 37, 1000)
    wavelet = fmindex.Wavelet(sequence, 37)
    for symbol in (0, 1, 17, 36):
        places = np.arange(0, 1001, 7)
        own = wavelet.rank(np.full(len(places), symbol), places) - wavelet.rank(np.array([symbol]), np.array([0]))
        assert own.tolist() == [int((sequence[:p] == symbol).sum()) for p in places]


def test_segments_cover_each_window_once():
    text = prose(11, 400)
    kind = fmindex.kind(20, 8)
    units, _ = kind.split(text.encode())
    found = anchors.segments(units, np.array([0, 15, 150, len(units)]), kind)
    seen = sorted((t, s + k) for t, s, n in zip(found["text"], found["start"], found["n"], strict=True) for k in range(n))
    assert seen == [(1, k) for k in range(116)] + [(2, k) for k in range(len(units) - 150 - 19)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, SMALL).collect())


def test_similar_documents(spark):
    """Pairs above the threshold meet, others stay apart, and exact copies of copies are one group."""
    draw, texts = random.Random(9), []
    for k in range(40):
        words = prose(500 + k, draw.randint(60, 300)).split()
        texts.append(" ".join(words))
        for share in (0.002, 0.01, 0.015, 0.2):
            other = [prose(draw.randrange(10**6), 1) if draw.random() < share else w for w in words]
            texts.append(" ".join(other))
    texts += texts[:3]
    sets = [set(simhash.spans(t, 5)) for t in texts]
    own = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a)}
    near = [p for p, j in likeness.items() if j >= 0.82]
    assert len(near) > 100 and np.mean([own[a] == own[b] for a, b in near]) >= 0.98
    apart = [p for p, j in likeness.items() if j < 0.3]
    assert not any(own[a] == own[b] for a, b in apart)
    assert all(own[len(texts) - 3 + k] == own[k] for k in range(3))


def edited(words, seed, share):
    """The words, with single words exchanged until five-word shingles of that similarity stay."""
    draw, out = random.Random(seed), list(words)
    base = set(simhash.spans(" ".join(words), 5))
    for k in draw.sample(range(len(words)), len(words)):
        kept, out[k] = out[k], f"new{seed}x{k}"
        now = set(simhash.spans(" ".join(out), 5))
        if len(base & now) < share * len(base | now):
            out[k] = kept
            break
    return " ".join(out)


def test_star_of_similar_documents(spark):
    """Copies that are like their original only are all found, however many there are."""
    words = prose(77, 250).split()
    texts = [edited(words, k, 0.8) for k in range(1500)] + [" ".join(words)]
    own = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([own[k] == own[1500] for k in range(1500)]) >= 0.97


def test_most_of_a_crowd_meets_the_rest_once(spark, monkeypatch):
    draw, words, rows, old = random.Random(6), prose(78, 250).split(), [], simhash.crowd_pairs

    def counted(members, *rest):
        rows.append(members.count())
        return old(members, *rest)

    monkeypatch.setattr(simhash, "crowd_pairs", counted)
    texts = []
    for changes in [1] * 40 + [7] * 6:
        at = set(draw.sample(range(250), changes))
        texts.append(" ".join(prose(draw.randrange(10**6), 1) if k in at else w for k, w in enumerate(words)))
    own = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [simhash.shingle_set(t, 5) for t in texts]
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    assert [own[k] for k in range(40)] == [0] * 40 and all((own[k] == 0) == any(near(sets[k], x) for x in sets[:40]) for k in range(40, 46))
    assert max(rows) <= 2 * len(texts)  # and not a row for each of 40 classes under each of their keys


@pytest.mark.parametrize("tile", [2048, 64])
def test_group_below_the_threshold_makes_no_rows_of_pairs(spark, monkeypatch, tile):
    """All 400 are candidates for one another and none is a link; the few true copies are found all the same, in one tile or over several."""
    words, rows, old = prose(79, 250).split(), [], simhash.alike

    def counted(pairs, *rest):
        rows.append(pairs.count())
        return old(pairs, *rest)

    monkeypatch.setattr(simhash, "alike", counted)
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = [edited(words, k, 0.83) for k in range(400)]
    texts += [edited(texts[k].split(), 1000 + k, 0.93) for k in range(20)]
    sets = [set(simhash.spans(t, 5)) for t in texts]
    right = roots([(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(texts)))
    ids = [k - 1 for k in range(len(texts))]  # -1 is an id like any other
    own = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert own == {k - 1: r - 1 for k, r in right.items()} and len(set(right.values())) >= 380
    assert sum(rows) <= 60 * len(texts)  # of 88,000; keys of few classes make some for each, however many classes there are


def test_similar_only_if_the_shingles_are(spark):
    """On either side of the threshold."""
    texts, right = [], []
    for k in range(150):
        words = prose(900 + k, 300).split()
        texts += [" ".join(words), edited(words, k, 0.8 if k % 2 else 0.775)]
        a, b = (set(simhash.spans(t, 5)) for t in texts[-2:])
        right.append(len(a & b) / len(a | b) >= 0.8)
    assert sum(right) == 75
    own = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    met = np.array([own[2 * k] == own[2 * k + 1] for k in range(150)])
    assert not met[~np.array(right)].any() and met[right].mean() >= 0.94
