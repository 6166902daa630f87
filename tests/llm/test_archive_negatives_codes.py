import base64
import glob
import gzip
import hashlib
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqcorpus.llm import hard_negatives, vector_codes, warc
from seqcorpus.llm.common import hot_join, shared_folder, written

NAN, INF = float("nan"), float("inf")


def _folder(spark):
    return f"{shared_folder(spark)}/test-warc-{uuid.uuid4().hex}"


PAGES = [
    (7, "http://a/", "<p>same</p>", "x"), (3, "http://b/?q=é 1", "<p>same</p>", "x"), (9, "http://c/\r\nWARC-Type: evil", "<p>same</p>", "x"),
    (4, None, None, "x"), (5, "http://d/", "", "x"), (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", "x"),
    (8, "u", "ends in lines\r\n\r\n", "x"), (10, "u", "\x1f\x8b été 中文 \U0001f44d \x00", "x"), (11, "u", "long " * 200_000, "x"),
    (12, "u", "twice", "x"), (12, "u", "twice", "x"), (None, "u", "twice", "x"), (None, None, "null id", "x"),
]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def brute_index(rows, least=0):
    owner, out = {}, []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            owner[body] = min(owner.get(body, page), page)
    seen = set()
    for page, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        body = (html or "").encode()
        first = len(body) < least or (body not in seen and owner.get(body) == page)
        seen |= {body} if len(body) >= least else set()
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else owner.get(body)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_archive_index(spark, least):
    folder = _folder(spark)
    warc.archive(warc.page_records(_pages(spark, PAGES)), folder, least=least, file_bytes=1 << 18)
    assert sorted(map(tuple, warc.index(spark, folder).collect()), key=str) == brute_index(PAGES, least)
    raw = [gzip.open(f).read() for f in glob.glob(folder.removeprefix("file:") + "/warc/*.gz")]
    records = [r for f in raw for r in warc.split_records(f)]
    assert len(records) == len(PAGES) and sum(f.count(b"<p>same</p>") for f in raw) == (1 if least == 0 else 1)
    again = [f for f, _, _ in records if f["warc-type"] == "revisit"]
    assert all(f["warc-profile"] == warc.PROFILE and f["warc-refers-to"].startswith("<urn:uuid:") for f in again)
    assert not any("evil" == f.get("warc-type") for f, _, _ in records)


def test_restore_is_exact(spark):
    """The original records come back byte for byte, also payloads that are no UTF-8."""
    folder = _folder(spark)
    records = warc.page_records(_pages(spark, PAGES)).select("id", "head", "payload")
    odd = spark.createDataFrame([(90, bytearray(bytes(range(256)) * 3)), (91, bytearray(b"\xff\xfe\r\n\r\n")), (92, bytearray(b"\xff\xfe\r\n\r\n"))], "page_id long, html binary")
    odd = odd.withColumn("url", warc.F.lit("http://odd/"))
    records = written(records.unionByName(warc.page_records(odd).select("id", "head", "payload")), "test-records")
    warc.archive(records, folder, file_bytes=1 << 16)
    key = lambda r: (str(r.id), r.head, bytes(r.payload))
    assert sorted(map(key, warc.restore(spark, folder).collect())) == sorted(map(key, records.collect()))


def test_damage_is_found(spark):
    folder = _folder(spark)
    warc.archive(warc.page_records(_pages(spark, PAGES[:2])), folder)
    path = next(f for f in glob.glob(folder.removeprefix("file:") + "/warc/*.gz") if b"<p>same</p>" in gzip.open(f).read())
    raw = gzip.open(path).read().replace(b"<p>same</p>", b"<p>sane</p>")
    loose = f"{path}.warc"
    with open(loose, "wb") as out:
        out.write(raw)
    with pytest.raises(Exception, match="holds"):
        warc.read_warc(spark, "file:" + loose if folder.startswith("file:") else loose).collect()


def test_empty_archive(spark):
    folder = _folder(spark)
    warc.archive(warc.page_records(_pages(spark, [])), folder)
    assert warc.index(spark, folder).collect() == [] and warc.restore(spark, folder).collect() == []


def test_hot_join(spark):
    left = written(spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 1 THEN 'lost' ELSE cast(id AS string) END AS k"), "left")
    right = left.where("k <> 'lost'").groupBy("k").count()
    got = hot_join(left, right, "k", hot=4, least=10)
    want = left.join(right, "k", "left").select("id", "k", "count")
    assert sorted(map(str, got.select("id", "k", "count").collect())) == sorted(map(str, want.collect()))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 70), st.integers(1, 70), st.integers(0, 70), st.sampled_from([3, 10**5, 2**31]), st.integers(0, 99))
def test_strassen(m, k, n, top, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-top, top + 1, (m, k)), rng.integers(-top, top + 1, (k, n))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 50)), max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_heaps_merge(entries, k, pieces):
    heaps = hard_negatives.Heaps(4, k)
    for p in range(pieces):
        part = entries[p::pieces]
        heaps.merge(*(np.array([e[i] for e in part], np.int64) for i in range(3)))
    got = list(zip(*(c.tolist() for c in heaps.entries())))
    want = [(q, s, i) for q in range(4) for s, i in sorted(((s, i) for e, s, i in entries if e == q), key=lambda x: (-x[0], x[1]))[:k]]
    assert got == want


ODD_VECTORS = [(2000, None, 1), (2001, [NAN] + [1.0] * 9, 1), (2002, [INF] + [1.0] * 9, 1), (2003, [None] + [1.0] * 9, 1), (2004, [], 1),
               (2005, [1.0] * 3, 1), (2006, [0.1] * 10, None), (None, [0.1] * 10, 1)]


def _vectors(spark, n, dim=10, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 1).astype(np.float32)
    x[n // 2:n // 2 + n // 3] = x[1]  # a hot vector, so that scores tie
    rows = [(int(i), [float(c) for c in r], int(rng.integers(0, 3))) for i, r in enumerate(x)]
    return rows, spark.createDataFrame(rows + ODD_VECTORS, "vec_id long, embedding array<float>, label int").withColumn("v", warc.F.lit(1)).repartition(5)


def brute_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x, _ in rows}
    label = {i: c for i, _, c in rows}
    out = []
    for a in [i for i in v if i % every == 0]:
        score = {i: int(v[a] @ v[i]) for i in v if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            hits = [i for i in order if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [1 << 25, 8 * 10 * 7])
def test_hard_negatives(spark, group_bytes):
    rows, df = _vectors(spark, 400)
    got = hard_negatives.mine(df, lambda v: v % 20 == 0, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 20)


def test_hard_negatives_odd_tables(spark):
    rows, df = _vectors(spark, 3)
    assert hard_negatives.mine(df.limit(0), lambda v: v % 20 == 0).collect() == []
    assert hard_negatives.mine(df.where("embedding IS NULL"), lambda v: v % 20 == 0).collect() == []
    twice = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.5, 0.0], 2), (2, [1.5, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(twice, "vec_id long, embedding array<float>, label int"), lambda v: v % 20 == 0).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got) == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30, 0.0], 1)], "vec_id long, embedding array<float>, label int"), lambda v: v % 20 == 0)


def brute_codes(rows, parts=2, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    x = [[int(np.floor(4096 * float(np.float32(c)))) for c in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]

    def scan():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        near = scan()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, n in zip(cut, near) if n[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    near = scan()
    error = [sum(d for d, _ in n) for n in near]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in n), e, by_label[r[2]], digest) for r, n, e in zip(rows, near, error)), key=str)


def test_vector_codes(spark):
    rows, df = _vectors(spark, 300)
    kept = rows + [ODD_VECTORS[6], ODD_VECTORS[7]]
    got = vector_codes.compress(df, parts=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(kept)


def test_vector_codes_few_rows(spark):
    rows = [(5, [1.0, 2.0], None), (5, [1.0, 2.0], None), (1, [-0.3, 0.7], 2)]
    schema = "vec_id long, embedding array<float>, label int"
    got = vector_codes.compress(spark.createDataFrame(rows, schema), parts=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows)
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame(rows, schema), parts=3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 6), st.integers(0, 999), st.data())
def test_active_entries_equal_full_scan(n, entries, seed, data):
    """After any update, comparing what may have changed gives what a full scan gives, ties included."""
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-3, 4, (n, 4)), rng.integers(-3, 4, (2, entries, 2))
    code, dist = vector_codes.assign(x, books)
    new = np.where(rng.random((2, entries, 1)) < data.draw(st.sampled_from([0.0, 0.3, 1.0])), rng.integers(-3, 4, (2, entries, 2)), books)
    got = vector_codes.assign(x, new, code, dist, (new != books).any(axis=2))
    want = vector_codes.assign(x, new)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
