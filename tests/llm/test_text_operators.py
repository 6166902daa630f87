import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqcorpus.llm import jaccard_join, lm_scoring, quality_classifier, quality_rules, suffix_dedup
from seqcorpus.llm.components import components
from seqcorpus.llm.induced_sort import suffix_array

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def variants(rnd, n, groups, length=(8, 120), vocabulary=400):
    vocab = [f"v{i}" for i in range(vocabulary)]
    docs = []
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(*length))]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [256, 6])
def test_jaccard_components(spark, monkeypatch, block):
    """With blocks of six, candidate groups are cut into many blocks and go through the second meeting."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = variants(random.Random(block), 14, 25) + [(10_000, None), (10_001, ""), (10_002, " "), (10_003, "a b c"), (10_004, "A b\tc"), (10_005, "a b c d")]
    got = jaccard_join.near_duplicates(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs) and len(got) == len(docs)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[6].component_id == by[7].component_id == 5
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and by[None].component_id is None
    assert jaccard_join.near_duplicates(no_docs).collect() == []


def test_tree_drops_no_link():
    rnd = random.Random(4)
    sets = [np.unique(np.array([rnd.randrange(1 << 56) for _ in range(40)], np.uint64)) for _ in range(30)]
    items = [np.unique(np.concatenate([rnd.choice(sets)[:rnd.randint(30, 40)], np.array([rnd.randrange(1 << 56) for _ in range(rnd.randint(0, 6))], np.uint64)])) for _ in range(200)]
    size = np.array([len(x) for x in items])
    order = np.argsort(size, kind="stable")
    items, size = [items[i] for i in order], size[order]
    a, b = jaccard_join.SignatureTree(np.stack([jaccard_join.bitmap(x, 9) for x in items]), size).pairs(80)
    left = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(200):
        for j in range(i + 1, 200):
            c = len(np.intersect1d(items[i], items[j]))
            if 100 * c >= 80 * (size[i] + size[j] - c):
                assert (i, j) in left
    assert len(left) < 200 * 199 / 2 / 3


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("memory", [4, 1 << 20])
def test_induced_sorting(memory):
    rng = np.random.default_rng(memory)
    for k in range(60):
        t = np.append(np.tile(rng.integers(1, 5, rng.integers(1, 9)), rng.integers(1, 12)) if k % 2 else rng.integers(1, 2 + k % 7, rng.integers(1, 90)), 0)
        listed = t.tolist()
        assert suffix_array(t, memory).tolist() == sorted(range(len(t)), key=lambda i: listed[i:])


def brute_repeats(texts, length):
    count = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("runs", [8192, 1])
def test_repeated_passages(spark, monkeypatch, runs, odd_docs, no_docs):
    monkeypatch.setattr(suffix_dedup, "RUNS", runs)
    rnd = random.Random(runs)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(30, 90))) for _ in range(6)]
    texts = ["".join([rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 6))]) for _ in range(150)]
    texts += ["ab" * 60, "x" * 100, "x" * 25, texts[0], texts[1], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs.withColumnRenamed("nothing", "x"), length=24, gram=8).collect()
    want = brute_repeats([(t or "").encode() for t in texts], 24)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == dict(enumerate(want))
    rows = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == 10 and {r.n_removed for r in rows if r.doc_id == 8} == {len("été 中文 \U0001f44d ok ".encode()) * 200}
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_repeats_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 300)
    rnd = random.Random(1)
    body = "".join(rnd.choice("abc") for _ in range(5000))
    texts = [body, body[100:1900] + "zz" + body[4000:], "y" * 50]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=24, gram=8).collect()
    want = brute_repeats([t.encode() for t in texts], 24)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == dict(enumerate(want))


def brute_statistics(text):
    t = text or ""
    w = WORDS.findall(t)
    lines, seen = [x for x in t.split("\n") if WORDS.search(x)], set()
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside))


def test_statistics(spark, odd_docs, no_docs):
    rnd = random.Random(6)
    texts = [r.text for r in odd_docs.collect()] + ["".join(rnd.choice(["a", "b", "c ", " ", "\n", "#", "a b c d e ", "X", "\x0b"]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    got = quality_rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id]), texts[r.doc_id]
    assert quality_rules.statistics(no_docs).collect() == []


def _judged(spark, seed, labelled=True):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.7
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(15, 60))]
        if not good:
            w = [x + "%%%" for x in w] if rnd.random() < 0.5 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int"), {x: y for x, y, _ in labels}


def test_decision_list(spark, odd_docs, no_docs):
    docs, labels, truth = _judged(spark, 5)
    rules = quality_rules.learn(docs, labels)
    assert 1 <= len(rules) <= 8 and all(str(c) for r in rules for c in r)
    other, _, truth = _judged(spark, 6)
    got = quality_rules.apply_rules(quality_rules.statistics(other), rules).collect()
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in got]) > 0.99 and all(r.kept for r in got if truth[r.doc_id])
    assert "PythonUDF" not in quality_rules.apply_rules(quality_rules.statistics(other), rules)._jdf.queryExecution().toString()
    odd = quality_rules.apply_rules(quality_rules.statistics(odd_docs), []).collect()
    assert {r.doc_id for r in odd if r.base_failed} == {1, 2, 3, 5, 6, 7, 8} and not [r for r in odd if r.base_failed and r.kept]
    assert quality_rules.learn(docs, labels.limit(0)) == [] and quality_rules.learn(no_docs, labels) == []


def test_weak_labels(spark, odd_docs, no_docs):
    docs, labels, truth = _judged(spark, 7)
    got = quality_classifier.classify(docs, labels).collect()
    assert np.mean([(r.quality_score >= 0.5) == bool(truth[r.doc_id]) for r in got]) > 0.97
    assert not any(r.toxic for r in got)
    assert len(quality_classifier.classify(odd_docs).collect()) >= 9
    assert quality_classifier.classify(no_docs).collect() == []


def test_estimation_finds_the_better_labeller():
    rnd = random.Random(3)
    seen = Counter()
    for _ in range(5000):
        good = rnd.random() < 0.8
        first = 1 if good and rnd.random() < 0.9 else 0
        second = -1 if not good and rnd.random() < 0.6 or good and rnd.random() < 0.002 else 0
        third = -1 if rnd.random() < 0.1 else 0
        seen[(first, second, third)] += 1
    share, prob, posterior = quality_classifier.estimate(dict(seen))
    assert 0.7 < share < 0.9 and prob[1, 0, 0] > 0.4 and prob[1, 1, 0] < 0.05
    assert posterior[(0, -1, 0)] < 0.2 < 0.8 < posterior[(1, 0, 0)]


@pytest.mark.parametrize("slice_words", [1 << 24, 40])
def test_language_model(spark, slice_words, odd_docs, no_docs):
    rnd = random.Random(1)
    vocab = [f"v{i}" for i in range(80)]
    texts = [" ".join(vocab[int(rnd.random() ** 2 * 80)] for _ in range(rnd.randint(0, 50))) for _ in range(200)] + [None, "  ", "unheard of words"]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), slice_words=slice_words).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    tokens = {d: [*words(t), None] for d, t in docs}
    c = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score <= 0
    assert len(lm_scoring.score(odd_docs).collect()) == 10
    assert lm_scoring.score(no_docs).collect() == []


def test_filter_never_forgets():
    rng = np.random.default_rng(5)
    key, count = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)), None
    count = rng.integers(1, 1000, len(key))
    seg = lm_scoring.segment_of(key, 7)
    parts = [lm_scoring.filter_segment(key[seg == s], count[seg == s], 1 << 30) for s in range(7)]
    filt = lm_scoring.LogFrequencyFilter(np.concatenate(parts), np.array([8 * len(p) for p in parts], np.uint64))
    assert (filt.level(key) >= lm_scoring.level_of(count)).all()
    assert (filt.level(key) == lm_scoring.level_of(count)).mean() > 0.95
    assert (filt.level(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.08
