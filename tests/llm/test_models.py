"""Learnt operators: exact parts against brute force, learnt parts by held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import odd_rows, prose, small_rows

from voltloom.llm import folds, hosts, linecrf, quality, queries, toxicity

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def auc(scores, labels):
    pairs = sorted(zip(scores, labels, strict=True))
    ranks = {}
    for score, group in itertools.groupby(enumerate(pairs), key=lambda x: x[1][0]):
        at = [k for k, _ in group]
        ranks[score] = sum(at) / len(at)
    good = sum(labels)
    return (sum(ranks[s] for s, y in pairs if y) - good * (good - 1) / 2) / (good * (len(pairs) - good))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_fold(spark):
    rows = spark.range(50).select("id", folds.held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in rows)


def test_labels_of_the_fold_are_not_learnt(odd, odd_labels):
    rows = folds.labelled(odd, odd_labels, "quality", 100).collect()
    assert rows and not any(held(r.doc_id) for r in rows) and {r.label for r in rows if r.doc_id == 2} <= {0}
    assert folds.labelled(odd, odd_labels, "quality", 2).select("doc_id").distinct().count() <= 2


def base(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_line_crf(spark):
    own = {r.doc_id: r for r in queries.op4_line_crf(spark, SMALL).collect()}
    label = {r["doc_id"]: r["quality"] for r in small_rows(spark, "labels")}
    docs = small_rows(spark)
    for doc in docs:
        assert tuple(own[doc["doc_id"]][n] for n in NAMES) == base(doc["text"])
        assert not (own[doc["doc_id"]].base_failed and own[doc["doc_id"]].kept)
    judged = [(own[i].kept, y) for i, y in label.items() if not own[i].base_failed]
    assert np.mean([k == bool(y) for k, y in judged]) > 0.95
    assert all(k for k, y in judged if y)


def test_odd_line_crf(odd, nothing, odd_labels):
    weights = linecrf.fit(odd, odd_labels)
    own = linecrf.judge(odd, weights).collect()
    texts = Counter(base(t or "") for _, t, *_ in odd_rows())
    assert Counter(tuple(r[n] for n in NAMES) for r in own) == texts
    assert linecrf.judge(nothing, linecrf.fit(nothing, odd_labels)).count() == 0
    assert all(r.kept != r.base_failed for r in linecrf.judge(odd, linecrf.fit(odd, odd_labels.limit(0))).collect())


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(1)
    for _ in range(20):
        weights = draw.normal(size=1 + linecrf.FEATURES + 4)
        bits = draw.integers(0, 1 << linecrf.FEATURES, draw.integers(1, 8)).tolist()
        own = linecrf.spread(np.array(bits)) @ weights[:-4]
        edge = weights[-4:].reshape(2, 2)
        score = lambda y: sum(own[k] for k, v in enumerate(y) if v) + sum(edge[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(bits)), key=score)
        assert abs(score(linecrf.viterbi(bits, weights)) - score(best)) < 1e-9


def test_query_quality(spark):
    own = {r.doc_id: r for r in queries.op7_quality_pu(spark, MIDDLE).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(own) == 1000 and all(r.held_out == held(i) and r.predicted == (r.score >= 0.3) for i, r in own.items())
    rows = [(own[i].score, y) for i, y in label.items() if held(i)]
    assert auc(*zip(*rows)) > 0.97 and np.mean([(s >= 0.3) == y for s, y in rows]) > 0.93


def test_risk_is_never_negative():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 1, (300, 256 + quality.EXTRA)), draw.normal(-1, 1, (150, 256 + quality.EXTRA))
    model = quality.train(good[:150], np.vstack([good[150:], bad]), 0.5)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_odd_quality(odd, nothing, odd_labels):
    model = quality.fit(odd, odd_labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality.score(nothing, quality.fit(nothing, odd_labels)).count() == 0
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row = [row[0] + 1, *row[1:]] if not b else _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [row[0] + 1]
    for k, y in enumerate(b):
        out.append(min(row[k] + (x != y), row[k + 1] + 1, out[-1] + 1))
    return out


def test_levenshtein_automata():
    draw = random.Random(2)
    terms = ["abc", "abcde", "bacde", "abcdefghi", "aabbccddee", "abab"]
    lexicon = toxicity.Lexicon(terms)
    words = {"".join(draw.choices("abcde", k=draw.randint(1, 7))) for _ in range(2000)} | set(terms)
    for term in terms:
        for _ in range(200):
            w = list(term)
            for _ in range(draw.randint(0, 3)):
                k = draw.randrange(len(w) + 1)
                w[k : k + draw.randint(0, 1)] = draw.choices("abcdefghi", k=draw.randint(0, 1))
            words.add("".join(w) or "a")
    found = lexicon.look_up(words)
    for w in words:
        near = min((levenshtein(w, t) for t in terms if levenshtein(w, t) <= toxicity.edits(t)), default=None)
        assert (found[w] and found[w][1]) == near, w


def test_stems():
    lexicon = toxicity.Lexicon(["lowei*", "loser", "lows"])
    found = lexicon.look_up({"lowei", "loweischaft", "lowe", "loveischaft", "losser", "lows", "lowsy", "loweir"})
    name = {w: f and (lexicon.terms[f[0]], f[1]) for w, f in found.items()}
    assert name["lowei"] == name["loweischaft"] == ("lowei*", 0) and name["lows"] == ("lows", 0) and name["losser"] == ("loser", 1)
    assert name["loweir"] == ("lowei*", 0) and name["lowe"] is name["loveischaft"] is name["lowsy"] is None


def test_quotations():
    say = 'He said "you idiot of a man" and left. idiot " x'
    assert toxicity.quoted(say, say.index("idiot"), say.index("idiot") + 5)
    assert not toxicity.quoted(say, say.rindex("idiot"), say.rindex("idiot") + 5)
    assert not toxicity.quoted('"\nidiot\n"', 2, 7)


def test_query_toxicity(spark):
    own = {r.doc_id: r for r in queries.op8_toxicity(spark, LARGE).collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = [(own[i].predicted, y) for i, y in label.items() if held(i)]
    assert len(own) == 10000 and np.mean([p == y for p, y in rows]) > 0.95
    assert sum(p for p, y in rows if not y) == 0
    assert sum(p for p, y in rows if y) >= 0.9 * sum(y for _, y in rows)


def test_forms_near_terms():
    """Forms that clean documents hold as often are dismissed; in training a document does not count itself."""
    forms = toxicity.Forms({"idiom": (1, 30), "idiott": (5, 0), "idoit": (0, 1)}, 100, 900)
    assert forms.other("idiom") and not forms.other("idiott") and not forms.other("unseen")
    assert forms.other("idoit") and not forms.other("idoit", 0)
    assert forms.evidence("idiott") > forms.evidence("idiott", 1) > forms.evidence("idiom") == 0
    assert 0 < forms.evidence("unseen") < forms.evidence("idiott")
    lexicon = toxicity.Lexicon(["idiot"])
    plain, near, other = toxicity.figures(["an idiot here", "an idiott here", "an idiom here"], lexicon, forms)
    assert plain[0] > 0 and near[1] > 0 and near[6] > 0 and not other.any()


def test_odd_toxicity(odd, nothing, odd_labels):
    rows = toxicity.score(odd, toxicity.fit(odd, odd_labels)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, odd_labels)).count() == 0
    assert {r.predicted for r in toxicity.score(odd, toxicity.fit(odd, odd_labels.limit(0))).collect()} == {0}


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_rules(spark):
    urls = [
        None, "", "no scheme/x", "HTTP://A.Example.NET/en/1", "http://example.com/de/", "http://badexample.com/de/", "https://x.org/fr/?a", "ftp://net", "http://net/",
        "a://b://c/d", "http://h?x=/de/", "http://h#/x", "http://EXAMPLE.net/EN/", "http://ünet/Ö", "http://casinowin.example.org/x/Y",
    ]
    pages = spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(urls)] + [(3, urls[3], "<p>a b</p>", 1)], "page_id long, url string, html string, host int")
    own = hosts.judge(pages, queries.RULES).collect()
    assert len(own) == len(urls) + 1
    for r in own:
        host, path, rule = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert hosts.judge(pages.limit(0), queries.RULES).count() == 0


def test_query_hosts(spark):
    pages = {p["page_id"]: p["url"] for p in small_rows(spark, "pages")}
    for r in queries.op9_host_words(spark, SMALL).collect():
        host, path, rule = rule_of(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and (not rule or rule[1] == r.verdict)


def test_bad_hosts_are_learnt(spark):
    """Words of blocked hosts block a host that only runs them together."""
    word = lambda k: ["casino", "pills", "garden", "music"][k]
    rows = [(k, f"http://{word(k % 2)}{word((k + 1) % 2)}{k}.net/x", "<p>casino pills garden music</p>") for k in range(40)]
    rows += [(100 + k, f"http://{word(2 + k % 2)}-{word(2 + (k + 1) % 2)}{k}.org/fr/x", "<p>garden music</p>") for k in range(40)]
    rows += [(200, "http://pillscasino.info/x", None), (201, "http://musicgarden.info/x", None)]
    own = {r.page_id: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert own[200].words[:2] == ["pills", "casino"] and own[200].verdict == "block"
    assert own[201].words[:2] == ["music", "garden"] and own[201].verdict == "allow"


@pytest.mark.parametrize("label", ["", "ab", "abcab", "zzabq", prose(3, 1)])
def test_split_is_the_likeliest(label):
    counts = {"a": 5, "b": 2, "ab": 4, "abc": 3, "ca": 1, "q": 1}
    total = 16
    cost = lambda w: np.log(counts[w] / total) if w in counts else -np.log(total + 1.0) - 2.3 * len(w)
    own = hosts.split_label(label, counts, total)
    assert "".join(own) == label
    every = [[label[a:b] for a, b in itertools.pairwise((0, *cut, len(label)))] for k in range(len(label)) for cut in itertools.combinations(range(1, len(label)), k)]
    assert not every or abs(sum(map(cost, own)) - max(sum(map(cost, e)) for e in every)) < 1e-9
