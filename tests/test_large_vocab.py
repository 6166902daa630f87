"""Vocabularies that the driver doesn't hold, and words counted once, against plain versions."""

import random

from pyspark.sql import functions as F

from seqcorpus.functions.text import arrow_words
from seqcorpus.operators import encode as enc
from seqcorpus.operators import vocab as voc

WORDS = ["a", "bb", "ccc", "é", "<unk>", "</s>", "x y", "", " ", " ", "z z", "\x1f"]


def _texts(n, seed=3):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else " ".join(rng.choice(WORDS + [f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_arrow_words_are_pythons():
    import pyarrow as pa

    texts = [None, *_texts(50), *[f" a{chr(c)}b " for c in range(0x3100)]]
    for some in (texts, texts[3:]):
        offsets, words = arrow_words(pa.array(texts)[len(texts) - len(some):])
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(offsets, offsets[1:])] == [(t or "").split() for t in some]


def test_words_counted_on_arrow_batches(spark):
    rows = [(None if i % 11 == 0 else i // 3, i % 3, t) for i, t in enumerate(_texts(400))]
    random.Random(1).shuffle(rows)
    rows += rows[:30]
    count, first = {"</s>": sum(t is not None for *_, t in rows)}, {}
    for doc, line, t in rows:
        for pos, w in enumerate((t or "").split()):
            count[w] = count.get(w, 0) + 1
            if doc is not None:
                first[w] = min(first.get(w, (doc, line, pos)), (doc, line, pos))
    for s in voc.SPECIAL_SYMBOLS:
        count[s] = count.get(s, 0) + 1
        first.pop(s, None)
    df = spark.createDataFrame(rows, "doc long, line int, text string").repartition(5)
    big = df.withColumn("doc", F.col("doc") + 10**18)  # keys of over 18 digits are counted as exploded rows
    for lines, base in ((df, 0), (big, 10**18)):
        for tokens in (None, "t"):
            got = voc.count_words(lines.withColumn("t", voc.tokenize("text")), ["doc", "line"], tokens_col=tokens).collect()
            assert {r.symbol: r["count"] for r in got} == count and len(got) == len(count)
            assert {r.symbol: (r.first[0] - base, *r.first[1:]) for r in got if r.first and r.first[0] is not None} == first


def test_a_vocabulary_beyond_the_drivers_bound_is_ranked_outside_it(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(_texts(300))), "line long, text string")
    want = [sorted(map(tuple, voc.build_vocab(df, ["line"], nwords=n).collect())) for n in (20, 1000)]
    monkeypatch.setattr(voc, "DRIVER_WORDS", 8)
    made = []
    plain = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or plain(self, data, *a, **k))
    got = [sorted(map(tuple, voc.build_vocab(df, ["line"], nwords=n).collect())) for n in (20, 1000)]
    assert got == want and max(made) < 16


def test_words_are_counted_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    counts = spark.createDataFrame([(f"w{i}", i + 1, (i, 0)) for i in range(40)], "symbol string, count long, first struct<line: long, pos: int>").mapInArrow(
        seen, "symbol string, count long, first struct<line: long, pos: int>")
    for nwords in (12, -1):
        before = runs.value
        assert voc.finalize_vocab(counts, nwords=nwords).count() in (16, 48)
        assert runs.value - before == 40


def test_lines_without_keys_meet_a_vocabulary_too_large_to_ship(spark, monkeypatch):
    rows = [(i % 40, t) for i, t in enumerate(_texts(200))] * 2 + [(0, "w1 nowhere w1"), (None, "a a")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(4)
    vocab = voc.build_vocab(df, ["k"], nwords=50)
    monkeypatch.setattr(enc, "BLOCK_BYTES", 200)
    text = lambda e: sorted(((r.k, r.text, r.ids and list(r.ids)) for r in e.collect()), key=repr)
    for options in ({}, {"reverse_order": True}, {"append_eos": False}):
        want = text(enc.encode_lines(df, vocab, **options))
        assert text(enc.encode_lines(df, vocab, max_broadcast_rows=5, **options)) == want
        words = df.withColumn("w", voc.tokenize("text"))
        assert text(enc.encode_tokens(words, vocab, "w", max_broadcast_rows=5, **options)) == want
    assert [r for r in want if r[1] == "w1 nowhere w1"]
