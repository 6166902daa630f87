"""Golden vocabulary/encoding rows (dictionary unit test of the reference) and round trips."""

from pyspark.sql import functions as F

from seqcorpus.functions.text import tokenize
from seqcorpus.operators import encode as enc
from seqcorpus.operators import vocab as voc

LINES = [(0, "A B C D"), (1, "B C D"), (2, "C D"), (3, "D")]


def _lines(spark):
    return spark.createDataFrame(LINES, "line_no long, text string")


def test_finalize_golden(spark):
    vocab = voc.build_vocab(_lines(spark), ["line_no"], padding_factor=8)
    rows = {r.symbol: r.id for r in vocab.collect()}
    assert [rows[s] for s in ["D", "C", "B", "A"]] == [4, 5, 6, 7]
    assert rows["</s>"] == 2 and rows["<unk>"] == 3 and rows["<pad>"] == 1
    assert vocab.count() % 8 == 0


def test_encode_golden(spark):
    vocab = voc.build_vocab(_lines(spark), ["line_no"])
    out = enc.encode_lines(_lines(spark), vocab).orderBy("line_no").collect()
    assert [list(r.ids) for r in out] == [[7, 6, 5, 4, 2], [6, 5, 4, 2], [5, 4, 2], [4, 2]]
    rev = enc.encode_lines(_lines(spark), vocab, reverse_order=True).orderBy("line_no").collect()
    assert list(rev[0].ids) == [4, 5, 6, 7, 2]
    shuf = enc.encode_lines(_lines(spark), vocab, how="shuffle", key_cols=["line_no"]).orderBy("line_no").collect()
    assert [list(r.ids) for r in shuf] == [list(r.ids) for r in out]


def test_first_seen_ties_and_counts(spark):
    df = spark.createDataFrame([(0, "x y z"), (1, "z y x <unk>")], "line_no long, text string")
    c = {r.symbol: r for r in voc.count_words(df, ["line_no"]).collect()}
    assert c["</s>"]["count"] == 3 and c["<unk>"]["count"] == 2 and c["<Lua heritage>"]["count"] == 1
    vocab = {r.symbol: r.id for r in voc.build_vocab(df, ["line_no"]).collect()}
    assert (vocab["x"], vocab["y"], vocab["z"]) == (4, 5, 6)


def test_unk_stats_and_decode(spark):
    vocab = voc.build_vocab(_lines(spark), ["line_no"], threshold=2)  # A (count 1) drops out
    test = spark.createDataFrame([("g", 0, "A B Q <unk>"), ("g", 1, "")], "g string, line_no long, text string")
    st = enc.encode_stats(test, vocab, ["g"]).collect()[0]
    assert (st.nseq, st.ntok, st.nunk, st.replaced) == (2, 6, 2, 2)
    e = enc.encode_lines(test, vocab)
    d = {r.line_no: r.out for r in enc.decode(e.select("line_no", "ids"), vocab, out_col="out").collect()}
    assert d[0] == "<unk> B <unk> <unk>" and d[1] == ""


def test_whitespace_class(spark):
    ws = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    s = "a" + ws + "b" + ws
    got = spark.createDataFrame([(s,)], "t string").select(tokenize("t").alias("x")).first().x
    assert got == s.split()
    assert spark.createDataFrame([("",)], "t string").select(F.size(tokenize("t"))).first()[0] == 0
