"""Binary indexed datasets, raw text, splits and the printer's format: round trips and fixed examples."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcorpus.sources import files as fs
from seqcorpus.sources import indexed as ix


def _rows(df):
    return [tuple(r) for r in df.orderBy("item").collect()]


def test_indexed_round_trip(spark, tmp_path):
    rows = [(i, None if i == 7 else [] if i == 3 else list(range(2, 2 + i % 13))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(5)
    path = str(tmp_path / "set")
    ix.write_indexed(df, path, ["k"], shards=4)
    want = [(i, [len(ids or [])], list(ids or [])) for i, ids in rows]
    assert _rows(ix.read_indexed(spark, path, items=37)) == want
    names = sorted(os.listdir(path))
    assert len(names) > 2 and all(n.startswith("part-") for n in names)
    # one shard is a dataset by itself: header, offsets and ids plus one on disk
    raw = open(os.path.join(path, "part-00000.idx"), "rb").read()
    code, size, n, s = struct.unpack("<4Q", raw[16:48])
    assert raw[:8] == b"TNTIDX\x00\x00" and (code, size) == (4, 4) and n == s and len(raw) == 48 + 8 * (2 * (n + 1) + s)
    values = np.fromfile(os.path.join(path, "part-00000.bin"), np.int32)
    assert values.tolist() == [v + 1 for _, ids in rows[:n] for v in ids or []]
    single = ix.read_indexed(spark, os.path.join(path, "part-00001"), items=10)
    assert [r[2] for r in _rows(single)] == [w[2] for w in want[n:n + single.count()]]


def test_indexed_ranges_are_pruned(spark, tmp_path):
    path = str(tmp_path / "set")
    ix.write_indexed(spark.range(1000).select("id", F.array("id").alias("ids")), path, ["id"])
    some = ix.read_indexed(spark, path, items=50).where("item >= 420 AND item < 433")
    assert [r[0] for r in _rows(some)] == list(range(420, 433)) and some.rdd.getNumPartitions() <= 2
    assert [r[2] for r in _rows(ix.read_indexed(spark, path, items=50).where("item = 999"))] == [[999]]
    assert _rows(ix.read_indexed(spark, path, items=50).where("item > 999")) == []


def test_indexed_several_dimensions(spark, tmp_path):
    """A file made by hand: items of shapes (2, 2) and (3,), 16-bit elements, no shift."""
    prefix = str(tmp_path / "hand")
    np.array([1, 2, 3, 4, 7, 8, 9], "<i2").tofile(prefix + ".bin")
    with open(prefix + ".idx", "wb") as f:
        f.write(b"TNTIDX\x00\x00" + struct.pack("<5Q", 1, 3, 2, 2, 3) + np.array([0, 2, 3, 0, 4, 7, 2, 2, 3], "<i8").tobytes())
    assert _rows(ix.read_indexed(spark, prefix, shift=0)) == [(0, [2, 2], [1, 2, 3, 4]), (1, [3], [7, 8, 9])]


def test_indexed_failure_leaves_no_shard(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.range(200).repartition(4).select("id", F.when(F.col("id") == 150, F.array(F.lit(1 << 40))).otherwise(F.array("id")).alias("ids"))
    with pytest.raises(Exception, match="don't fit"):
        ix.write_indexed(rows, path, ["id"], shards=4)
    assert not os.path.isdir(path) or os.listdir(path) == []
    ix.write_indexed(rows.where("id < 100"), path, ["id"])
    with pytest.raises(Exception, match="holds an indexed dataset"):
        ix.write_indexed(rows.where("id < 100"), path, ["id"])


def test_indexed_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "none")
    ix.write_indexed(spark.createDataFrame([], "k int, ids array<int>"), path, ["k"])
    assert _rows(ix.read_indexed(spark, path)) == []
    (tmp_path / "bad.idx").write_bytes(b"something else" * 9)
    (tmp_path / "bad.bin").write_bytes(b"")
    with pytest.raises(Exception, match="no index of version"):
        ix.read_indexed(spark, str(tmp_path / "bad")).collect()


def test_raw_text(spark, tmp_path):
    rows = [(0, "train", "en", " a  b "), (1, "train", "en", ""), (2, "train", "de", "ä"), (3, "valid", "en", "c")]
    path = str(tmp_path / "raw")
    fs.write_raw(spark.createDataFrame(rows, "n int, split string, lang string, text string"), path, order_cols=["n"])
    assert sorted(map(tuple, fs.read_raw(spark, path).collect())) == sorted(r[1:] for r in rows)
    lines = [open(os.path.join(d, f)).read() for d, _, names in os.walk(path) for f in sorted(names) if f.startswith("part-") and "split=train/lang=en" in d]
    assert "".join(lines) == " a  b \n\n"


def test_split_parts(spark, tmp_path):
    for name, text in (("train.en-de.en", "a\nb\n"), ("train1.de-en.en", "c\n"), ("train3.en-de.en", "no\n"), ("valid.en-de.en", "v\n")):
        (tmp_path / name).write_text(text)
    parts = fs.split_parts(spark, str(tmp_path), "train", "en", "de", "en")
    assert [os.path.basename(p) for p in parts] == ["train.en-de.en", "train1.de-en.en"]
    got = fs.load_split(spark, parts).orderBy("id").collect()
    assert [(r.id, r.corpus_ord, r.text) for r in got] == [(0, 0, "a"), (1, 0, "b"), (2, 1, "c")]
    assert [r.text for r in fs.load_split(spark, parts, combine=False).orderBy("id").collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        fs.split_parts(spark, str(tmp_path), "test", "en", "de", "en")
    assert fs.split_names("a,b,c") == ["valid", "valid1", "valid2"]


def test_printer_format(spark, tmp_path):
    rows = [(5, 2, "s5", "t5", -1.5, "h5 two", [-1.0, -2.00005], [1, 0]), (5, 1, "s5", "t5", -0.25, "h5 one", [-0.5], [0]), (3, 1, "s3", None, -2.0, "", [], [])]
    df = spark.createDataFrame(rows, "id long, rank int, source string, target string, score double, hypothesis string, pos_scores array<double>, alignment array<int>")
    lines = [r.line for r in fs.write_generation_output(df).orderBy("id", "o").collect()]
    assert lines == ["S-3\ts3", "H-3\t-2.0\t", "P-3\t", "A-3\t", "S-5\ts5", "T-5\tt5", "H-5\t-0.25\th5 one", "P-5\t-0.5000", "A-5\t0",
                     "H-5\t-1.5\th5 two", "P-5\t-1.0000 -2.0001", "A-5\t1 0"]
    fs.write_lines(fs.write_generation_output(df), str(tmp_path / "out"), text_col="line", order_cols=["id", "o"])
    back = fs.read_generation_output(fs.read_lines(spark, str(tmp_path / "out"), per_file=False)).orderBy("id", "rank").collect()
    assert [(r.id, r["rank"], r.score, r.hypothesis, r.source, r.target) for r in back] == [
        (3, 1, -2.0, "", "s3", None), (5, 1, -0.25, "h5 one", "s5", "t5"), (5, 2, -1.5, "h5 two", "s5", "t5")]


def test_interactive_output(spark):
    text = ["| Type the input sentence and press return:", "O\tein Haus", "H\t-0.5\ta house", "P\t-0.2500 -0.7500", "A\t0 1", "H\t-2.0\thouse", "P\t-2.0000", "A\t1",
            "O\t", "H\t-1.0\t", "P\t", "O\tno result", "O\tx\ty", "H\t-3.0\tO\tq", "P\t-3.0000"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no long, text string").repartition(4)
    got = sorted((r.id, r["rank"], r.source, r.score, r.hypothesis, r.pos_scores, r.alignment) for r in fs.read_interactive_output(df).collect())
    assert got == [(0, 1, "ein Haus", -0.5, "a house", [-0.25, -0.75], [0, 1]), (0, 2, "ein Haus", -2.0, "house", [-2.0], [1]),
                   (1, 1, "", -1.0, "", [], None), (3, 1, "x\ty", -3.0, "O\tq", [-3.0], None)]
