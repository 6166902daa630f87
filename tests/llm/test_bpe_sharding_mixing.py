import math
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqcorpus.llm import byte_bpe, mixing, sharding

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_ids_as_tiktoken(peer):
    coder, rnd = byte_bpe.Coder(byte_bpe.read_ranks(PATH), PATTERN), random.Random(9)
    parts = ["a", " ", "  ", "\n", "\x1c", "\x85", " ", "　", "é", "é", "中", "\U0001d4b3", "\U0001f44d", "1", "٣", "!", "$$$", "'s", "'ll",
             "\x00", "\U0001917c", "ջ", "՘", "Aa"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + [c * n for c in "a -=\n0" for n in (1, 7, 64, 300)]
    flat, counts = coder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert flat[at:at + n].tolist() == peer.encode_ordinary(text), text
        at += n


def test_encode_decode_round_trip_and_offsets(spark, odd_docs, no_docs, peer):
    docs = odd_docs.withColumn("ids", F.lit("clash"))
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN, offsets=True), PATH, PATTERN, as_text=True).collect()
    assert len(got) == 10
    for r in got:
        text = r.text or ""
        assert r.decoded == text and r.ids == peer.encode_ordinary(text) and len(r.char_start) == len(r.ids)
        if r.ids:
            assert r.char_start[0] == 0 and r.char_end[-1] == len(text)
            assert all(a <= b for a, b in zip(r.char_start, r.char_end)) and r.char_start == sorted(r.char_start)
    assert byte_bpe.digests(no_docs, PATH, PATTERN).collect() == []
    part = spark.createDataFrame([(peer.encode_ordinary("\U0001f44d")[:1],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(part, PATH, PATTERN, as_text=True).collect()][1:] == ["", ""]


def test_shards(spark, odd_docs, no_docs):
    rows = sharding.shard(odd_docs, shards=4, seed=8).collect()
    assert len(rows) == 10 and {r.law for r in rows} == {"rows"}
    for r in rows:
        assert (r.shard, r.slot) == sharding.place(r.row_number, 10, 4, 8)
        assert sharding.row_at(r.shard, r.slot, 10, 4, 8) == r.row_number
    assert sorted(r.row_number for r in rows) == list(range(10))
    for r in rows:
        if r.doc_id == 1:
            assert (r.size, r.text_crc32) == (16, 0)
        if r.doc_id == 5:
            assert (r.size, r.text_crc32) == (29, zlib.crc32(b"one two three"))
    assert sharding.shard(no_docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 39, 40, 41, 1000, 4099])
def test_permutation_is_one(n):
    seen = sorted(sharding.place(i, n) for i in range(n))
    assert len(set(seen)) == n
    by = {}
    for s, slot in seen:
        by.setdefault(s, []).append(slot)
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == 40 else 0) <= 1


def _mix_docs(spark, sizes):
    rows = [(i, "w " * (1 + i % 5), s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_against_brute_force(spark):
    docs = _mix_docs(spark, {"big": 900, "mid": 150, "small": 60})
    rows = mixing.stream(docs, target_entropy=0.85, max_repeats=4.0, block_tokens=200, seed=3).collect()
    tokens = {r.doc_id: r.tokens for r in rows}
    source = {r.doc_id: r.source for r in rows}
    total = {}
    for d, s in source.items():
        total[s] = total.get(s, 0) + tokens[d]
    assert len(tokens) == 1110 and all(tokens[d] == 1 + 1 + d % 5 for d in tokens)
    top = max(total.values())

    def entropy(a):
        w = [(t / top) ** a for t in total.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(3)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.85 else (low, mid)
    low = max(low, 1 - math.log(4.0) / math.log(top / min(total.values())))
    epochs = {s: (t / top) ** (low - 1) for s, t in total.items()}
    for s, t in total.items():
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.tokens for r in own) - epochs[s] * t) <= 8
        copies = {}
        for r in own:
            copies.setdefault(r.copy, set()).add(r.doc_id)
        docs_of = {d for d in source if source[d] == s}
        assert all(copies[c] == docs_of for c in range(int(epochs[s] + 1e-9)))  # whole epochs hold every document
        assert abs(own[0].weight - epochs[s] * t / sum(epochs[x] * total[x] for x in total)) < 1e-4
    by = {}
    for r in rows:
        by.setdefault(r.block, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for s in total:  # every block holds each source's share of its budget, within a document or two
        per = epochs[s] * total[s] / len(by)
        for b in by:
            assert abs(sum(r.tokens for r in rows if r.block == b and r.source == s) - per) <= 14
    again = mixing.mixed(docs, target_entropy=0.85, max_repeats=4.0, block_tokens=200, seed=3).groupBy("doc_id").count().collect()
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert {r.doc_id: r["count"] for r in again} == count


def test_mixing_limit_and_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.stream(_mix_docs(spark, {"big": 600, "tiny": 10}), target_entropy=1.0, max_repeats=2.5).collect()
    copies = {}
    for r in rows:
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copy + 1)
    assert max(copies.values()) <= 3 and len(copies) == 610
    out = mixing.mixed(odd_docs).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, 7, 8, None} and list(out[0].asDict()) == odd_docs.columns
    assert mixing.mixed(no_docs).collect() == [] and mixing.stream(no_docs).collect() == []
