"""Merges learned several at a time against learning one by one, and their application."""

import random
from collections import Counter

import pytest

from seqcorpus.operators import bpe as bp
from seqcorpus.operators import scoring as sc


def plain_learn(words, n_merges):
    cur = [([*w[:-1], w[-1] + bp.END], f) for w, f in words if w]
    out = []
    for _ in range(n_merges):
        count = Counter()
        for syms, f in cur:
            for p in zip(syms, syms[1:]):
                count[p] += f
        if not count:
            break
        n, a, b = max((n, *(x.encode() for x in p)) for p, n in count.items())
        if n < 2:
            break
        a, b = a.decode(), b.decode()
        out.append((a, b))
        nxt = []
        for syms, f in cur:
            new, i = [], 0
            while i < len(syms):
                if syms[i:i + 2] == [a, b]:
                    new.append(a + b)
                    i += 2
                else:
                    new.append(syms[i])
                    i += 1
            nxt.append((new, f))
        cur = nxt
    return out


def plain_apply(word, merges):
    syms = [*word[:-1], word[-1] + bp.END]
    ranks = {m: r for r, m in enumerate(merges)}
    while True:
        found = sorted((ranks[p], p) for p in zip(syms, syms[1:]) if p in ranks)
        if not found:
            break
        a, b = found[0][1]
        i = 0
        while i < len(syms) - 1:
            if syms[i] == a and syms[i + 1] == b:
                syms[i:i + 2] = [a + b]
            i += 1
    syms[-1] = syms[-1].removesuffix(bp.END)
    return "@@ ".join(s for s in syms if s)


CASES = {
    "letters": (1, "abcdefghijklm", 60, 9), "few letters": (2, "ab", 30, 8), "one letter": (3, "a", 6, 12), "ties": (4, "abcd", 40, 5),
    "odd signs": (5, "\\E\\Q$.</w>é中", 40, 6),
}


@pytest.mark.parametrize("case", CASES)
def test_learn_equals_one_by_one(spark, case):
    seed, letters, n, longest = CASES[case]
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.randint(1, 6 if case == "ties" else 40) for _ in range(n)}
    df = spark.createDataFrame([*words.items(), ("", 3)], "word string, freq long")
    got = [(r.left, r.right) for r in bp.learn_bpe(df, 40).orderBy("rank").collect()]
    assert got == plain_learn(list(words.items()), 40)
    if case == "letters":  # a short list of pairs must not change the outcome
        assert [(r.left, r.right) for r in bp.learn_bpe(df, 12, top=3).orderBy("rank").collect()] == got[:12]


def test_several_merges_a_job():
    """Pairs that share no symbols go together; a seam, a tie at a seam, a pair of equals or a known symbol ends the run."""
    top = [("a", "b", 9), ("c", "d", 8), ("e", "f", 7), ("b", "x", 6), ("g", "h", 5)]
    assert bp.safe_run(top, True, set(), 10) == top[:3]
    assert bp.safe_run(top, True, set(), 2) == top[:2]
    assert bp.safe_run([("a", "b", 9), ("c", "d", 6), ("b", "x", 6)], True, set(), 10) == [("a", "b", 9)]
    assert bp.safe_run([("a", "a", 9), ("c", "d", 8)], True, set(), 10) == [("a", "a", 9)]
    assert bp.safe_run([("a", "b", 9), ("c", "d", 8)], True, {"cd"}, 10) == [("a", "b", 9)]
    assert bp.safe_run([("a", "b", 9), ("c", "d", 8)], False, set(), 10) == [("a", "b", 9)]
    assert bp.safe_run([("a", "b", 1)], True, set(), 10) == []


def test_apply(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(w, words.count(w)) for w in set(words)], "word string, freq long")
    merges = bp.learn_bpe(df, 25)
    got = {r.symbol: r.pieces for r in bp.apply_bpe(spark.createDataFrame([(w,) for w in words], "symbol string"), merges).collect()}
    known = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == {w: plain_apply(w, known) for w in set(words)}


def plain_words(pieces, marker="@@"):
    """(word, score, pieces) with sums over joined pieces; an infinite sum is a gap."""
    out, word, score, n = [], "", 0.0, 0
    for i, (p, s) in enumerate(pieces):
        cont = p.endswith(marker) and i < len(pieces) - 1
        word, score, n = word + (p[:-len(marker)] if cont else p), score + s, n + 1
        if not cont:
            out.append((word, None if score in (float("inf"), float("-inf")) else round(score, 9), n))
            word, score, n = "", 0.0, 0
    return out


def test_word_probs(spark):
    rng = random.Random(3)
    hyps = {h: [(rng.choice(["a", "b@@", "c", "d@@", "@@", "e"]), rng.choice([-0.5, -1.25, float("-inf"), -2.0])) for _ in range(rng.randint(1, 12))] for h in range(60)}
    hyps[100] = [("x@@", -1.0)]
    rows = [(h, i, p, s) for h, ps in hyps.items() for i, (p, s) in enumerate(ps)]
    df = spark.createDataFrame(rows, "h int, pos int, piece string, score double")
    got = {}
    for r in sc.word_probs(df, ["h"]).orderBy("h", "word_no").collect():
        got.setdefault(r.h, []).append((r.word, None if r.score is None else round(r.score, 9), r.n_pieces))
    assert got == {h: plain_words(ps) for h, ps in hyps.items()}
    kept, gone = sc.drop_inf(df, "score")
    assert kept.count() + gone.count() == len(rows) and gone.where("score > -1e9").count() == 0
