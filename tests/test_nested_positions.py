"""Positions as arrays of a row against exploded ones, and lines numbered where they are read."""

import random

import pytest
from pyspark.sql import functions as F

from seqcorpus.operators import bigrams
from seqcorpus.operators import scoring as sc
from seqcorpus.plans.registry import REGISTRY
from seqcorpus.sources import files as fs


def _rows(spark, n=200, top=70):
    rng = random.Random(4)
    rows = [(i, [rng.choice([3, 4, 5, rng.randint(4, top)]) for _ in range(rng.randint(0, 12))] + [2]) for i in range(n)] + [(n, []), (n + 1, [2])]
    return spark.createDataFrame(rows, "k int, ids array<int>").repartition(4)


@pytest.mark.parametrize("bound", [{}, {"PART_PAIRS": 50}, {"MAX_PACKED": 0}, {"TASK_PAIRS": 10}, {"FAR": 2}, {"top": 90_000}])
def test_nested_positions(spark, monkeypatch, bound):
    rows = _rows(spark, top=bound.get("top", 70))
    for name, value in bound.items():
        if name != "top":
            monkeypatch.setattr(bigrams, name, value)
    flat, nested = sc.positions(rows.where("size(ids) > 0"), ["k"]), sc.positions(rows, ["k"], nested=True)
    one, two = sc.bigram_model(flat, 100, 1.0), sc.bigram_model(nested, 100, 1.0)
    assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, two[0].collect()))
    # scored by a model of other rows: pairs that it hasn't, contexts that it hasn't
    some = rows.where("k < 60 AND NOT array_contains(ids, 5)")
    for of in (rows, some):
        model = sc.bigram_model(sc.positions(of, ["k"], nested=True), 100, 1.0)
        want = {(r.k, r.pos): r.lp for r in sc.label_gather(flat, *model).collect()}
        got = sc.label_gather(nested, *model)
        assert {(r.k, i): x for r in got.collect() for i, x in enumerate(r.lps or [])} == want
        if "MAX_PACKED" not in bound:
            assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert None in want.values()


def test_output_of_documents_whose_id_occurs_again(spark, tmp_path):
    docs = [(1, "a b c\na a\nb"), (2, "c a\nb b b"), (2, "c a\nb b b"), (None, "a b"), (3, None), (4, "")]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = REGISTRY["src_15_write_generation_output"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.o) for r in out if r.id in (1, 4)) == [(1, o) for o in (0, 1, 3, 4, 6, 7)] + [(4, o) for o in (0, 1, 3, 4)]
    assert {r.id for r in out} == {1, 2, 4}
    back = REGISTRY["src_14_read_generation_output"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r["rank"]) for r in back if r.id != 2) == [(1, 1), (1, 2), (4, 1)] and len(back) > 3


def test_lines_of_several_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}").write_text("".join(f"{k} {i} {'x' * (i % 50)}\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for per_file in (True, False):
            lines = fs.read_lines(spark, str(tmp_path), per_file=per_file)
            got = [(r.line_no, r.text.split(" ")[:2]) for r in lines.orderBy("file_path", "line_no").collect()]
            assert got == [(i + (0 if per_file else 400 * k), [str(k), str(i)]) for k in range(3) for i in range(400)]
            plan = lines._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
