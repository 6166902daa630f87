import numpy as np
import pytest

from seqcorpus.llm import html_extract, nearest

SF = "/root/testdata/sf0.001"


def _text(page, counts=None):
    return html_extract.main_text(page, html_extract.weights(counts or {}))


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Site name</a></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav><!-- <p>not this</p> -->
    <div class="cookie-notice">We use cookies on this page, do accept them all now.</div>
    <article><h1>A &amp; B&nbsp;title</h1><p>First <b>bo</b>ld   text&#8217;s
    line<br>next</p><aside>see also this other thing</aside><p>Second &lt;p&gt; with <a title="x>y" href=/q>a link</a>.</p>
    <form><label>Name</label><input></form><div class="comments"><p>Great post, thanks for writing this down.</p></div></article>
    <footer>&copy; example</footer></body>"""
    assert _text(page) == "A & B title First bold text’s line next Second <p> with a link."


def test_page_without_article():
    page = "<body><div id='sidebar'><p>recent posts of this site and more</p></div><div id=content><p>One long paragraph of real text here.</p><p>And another one.</p></div><ul class=menu><li>x</ul>"
    assert _text(page) == "One long paragraph of real text here. And another one."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "<script>", "a < b", "<p", "<p>x", "</p></div>", "<p>" * 5000 + "deep", "&amp;" * 10, "<a b='", "<!-- x --> <b>y"])
def test_odd_pages(page):
    assert isinstance(_text(page), str)


def test_extract_query(spark):
    rows = [(1, "u", "<article><h1>T</h1><p>some words of text</p></article><footer>foot</footer>", 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(pages, html_extract.learn(pages)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "T some words of text", 20), ("2", "", 0), ("2", "", 0), ("None", "", 0)]
    assert html_extract.extract(pages.limit(0), html_extract.learn(pages.limit(0))).collect() == []


def _search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return nearest.search(df, lambda v: v % 20 == 0, **options).collect()


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[700:1200] = x[3]  # a hot vector
    rows = [(i, [float(v) for v in r], None) for i, r in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] + [1.0] * 11, 1), (2060, [1.0] * 5, 1), (2080, [None] + [1.0] * 11, 1), (None, [1.0] * 12, 1), (2100, [], 0)]
    got = {}
    for r in _search(spark, rows):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        score = np.array([np.sum(x[i] * x[q]) for i in range(1500)])
        score[q] = -np.inf
        want = np.lexsort((np.arange(1500), -score))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:]))
        hit += len({v for _, v, _ in found} & set(want.tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_nearest_few_rows(spark):
    got = _search(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (20, [0.5, 0.0], 1), (20, [0.5, 0.0], 1)])
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(0, 1), (0, 20), (0, 20), (20, 0), (20, 1)]
    assert _search(spark, []) == []


@pytest.mark.parametrize("stage", range(4))
def test_stage_columns_with_clashing_names(spark, stage):
    """Columns named like the operators' own pass through unchanged."""
    import corpus_pipeline

    names = ["_score", "_sdoc", "_rest", "_kept", "n_words", "kept", "n_removed", "n_bytes", "n_spans", "copy", "component_id", "base_failed", "_msource", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    docs = docs.select("*", *[corpus_pipeline.F.concat(corpus_pipeline.F.lit(f"{k}-"), "doc_id").alias(c) for k, c in enumerate(names)])
    got = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{k}-{r.doc_id}" for r in rows for k, c in enumerate(names))


def test_pipeline_against_brute_force(spark):
    """Every stage on sf0.001, each against a plain version of what it does."""
    import corpus_pipeline
    from test_text_operators import brute_components, brute_repeats, brute_statistics

    import public_tokenizers
    import tiktoken
    from seqcorpus.llm.byte_bpe import read_ranks
    from seqcorpus.llm.common import table, written
    from seqcorpus.llm.queries import RANKS

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]

    def run(name):
        nonlocal docs
        docs = written(stages[name](spark, docs, SF), "test")
        return docs.collect()

    rows = run("quality rules")
    assert docs.columns == columns and all(r == seen[r.doc_id] for r in rows)
    fails = {d for d, r in seen.items() if (s := brute_statistics(r.text))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert not fails & {r.doc_id for r in rows}
    label = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    assert {d for d, r in label.items() if r.quality == 1} - fails <= {r.doc_id for r in rows}

    want = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in rows]).items() if d == c}
    rows = run("n-gram Jaccard join")
    assert docs.columns == columns and sorted(r.doc_id for r in rows) == sorted(want)

    before = sorted(rows, key=lambda r: r.doc_id)
    rows = sorted(run("suffix-array dedup"), key=lambda r: r.doc_id)
    gone = brute_repeats([(r.text or "").encode() for r in before], corpus_pipeline.PASSAGE)
    assert docs.columns == columns and [r.doc_id for r in rows] == [r.doc_id for r in before]
    assert all(len((b.text or "").encode()) - g[1] - len(a.text.encode()) <= 3 * 2 * g[2] and a.n_chars == len(a.text) for a, b, g in zip(rows, before, gone, strict=True))
    assert all(a.text == (b.text or "") for a, b, g in zip(rows, before, gone, strict=True) if not g[1])

    kept = {r.doc_id: r for r in rows}
    rows = run("mixing sources to target weights")
    assert docs.columns == columns and {r.doc_id for r in rows} == set(kept) and all(r == kept[r.doc_id] for r in rows)

    rows = run("byte-level BPE encoding and decoding")
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    assert all(r.ids == peer.encode_ordinary(r.text) for r in rows)
