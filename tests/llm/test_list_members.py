"""Operator 2: what is moved follows the sets that can be linked, not the lists that chance makes; no link is lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcorpus.llm import jaccard_join


def _seen(monkeypatch, name):
    """The arguments of every call of a function of the module."""
    calls, real = [], getattr(jaccard_join, name)
    monkeypatch.setattr(jaccard_join, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])
    return calls


def _shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(docs, least):
    root = {d: d for d, _ in docs}
    sets = {d: _shingles(t) for d, t in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, _ in docs:
        for b, _ in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def _near(rnd, words, share):
    """The words with a share of them replaced or taken out, or with some more at the end."""
    out = [w if rnd.random() > share else f"n{rnd.random()}" for w in words]
    return out[:len(out) - rnd.randrange(max(1, len(out) // 6))] if rnd.random() < 0.5 else out + [f"m{rnd.random()}" for _ in range(rnd.randrange(max(1, len(out) // 6)))]


@pytest.mark.parametrize("least", [50, 80, 95])
def test_no_link_is_lost(spark, least):
    rnd = random.Random(least)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(5, 160))]
        texts += [words] + [_near(rnd, words, rnd.choice([0, 0.005, 0.01, 0.02, 0.04])) for _ in range(rnd.randrange(5))]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = _components(docs, least)
    assert 40 < len(set(want.values())) < len(docs)
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), least=least).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_sets_that_chance_brings_together_are_not_moved(spark, monkeypatch):
    asked, met = _seen(monkeypatch, "node_sets"), _seen(monkeypatch, "_meet")
    # as in large tables, where a bucket of counts holds so many shingles that none is rare
    table = jaccard_join.set_table
    monkeypatch.setattr(jaccard_join, "set_table", lambda *x: (lambda sets, counts: (sets, np.ones_like(counts)))(*table(*x)))
    common = [f"c{i}" for i in range(60)]
    # a passage shared by texts of which each is over a third longer than the one before
    docs = [(i, " ".join(common + [f"t{i}x{k}" for k in range(int(100 * 1.4 ** i) - 60)])) for i in range(12)]
    # texts of one size that share half of their words, and two near copies
    docs += [(20 + i, " ".join(common[:30] + [f"s{i}x{k}" for k in range(300)])) for i in range(30)]
    copy = [f"d{k}" for k in range(200)]
    docs += [(90, " ".join(copy)), (91, " ".join(copy[:195]))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.component_id != r.doc_id} == {91}
    assert asked[0][1].distinct().count() < 36  # before: all 44
    assert met[0][1].select("fp").distinct().count() == 2  # before: every set that was in a list


def test_members_without_a_partner_leave_a_list(spark):
    rows = [
        (1, 11, 100, 125, 2, 11), (1, 12, 130, 162, 2, 11),  # sizes too far apart
        (2, 11, 100, 100, 3, 11), (2, 13, 101, 101, 3, 11), (2, 14, 100, 100, 3, 11),  # 13 is too long for the places of the others
        (3, 11, 100, 125, 2, 11), (3, 14, 100, 125, 2, 11),  # what is left of list 2 once more
        (4, 11, 100, 80, 3, 11), (4, 12, 130, 104, 3, 11), (4, 13, 101, 81, 3, 11),  # longer than BLOCK: as it is
    ]
    members = spark.createDataFrame(rows, "key long, fp long, n int, most int, m long, low long")
    small, large = members.where("key < 4"), members.where("key = 4").withColumn("m", F.lit(jaccard_join.BLOCK + 1).cast("long"))
    got = jaccard_join.possible_members(small.unionAll(large)).collect()
    assert sorted((r.key, r.fp, r.m, r.low) for r in got if r.key < 4) == [(2, 11, 2, 11), (2, 14, 2, 11)]
    assert sorted((r.fp, r.m) for r in got if r.key == 4) == [(f, jaccard_join.BLOCK + 1) for f in (11, 12, 13)]
