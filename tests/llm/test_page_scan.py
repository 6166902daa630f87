"""The scan for the best stretch against all stretches, and pages that are deep, broken or oddly named."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqcorpus.llm import html_extract as he

WEIGHT = he.weights({})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["t:p", "t:nav", "in", "w:p", "w:link", "w:beside", "w:h1"]), st.integers(0, 4)), max_size=14))
def test_region_against_all_stretches(kinds):
    items = [("text", k, True, "w " * n, 0, k == "w:beside") if k.startswith("w:") else ("tag", k, True) for k, n in kinds]
    score = [WEIGHT(i[1]) * (len(i[3].split()) if i[0] == "text" and not i[5] else 1) for i in items]
    sums = {(a, b): sum(score[a:b]) for a in range(len(items)) for b in range(a + 1, len(items) + 1)}
    first, end = he.region(items, WEIGHT)
    best = max([0.0, *sums.values()])
    if best < 1e-6:
        assert sums.get((first, end), 0.0) < 1e-6
    else:
        assert sums[first, end] == pytest.approx(best)
        assert not any(s > sums[first, end] + 1e-6 for s in sums.values())


@pytest.mark.parametrize("page", [
    "<div class=widget>" * 20_000 + "text of words" + "</div>" * 20_000,
    "<div>" * 20_000 + "</p>" * 20_000 + "<h1>x</h1>" * 20_000,
    "<div class=widget>" * 10_000 + "<article>a b c</article>" * 10_000,
    "<section id=related><div class=comments>" * 10_000 + "words " * 50_000,
])
def test_deep_pages_take_time_by_their_length(page):
    start = time.process_time()
    he.main_text(page, WEIGHT)
    assert time.process_time() - start < 8


def test_text_of_the_article_under_odd_names():
    body = "".join(f'<p class="{c}">Paragraph number {i} of the article goes on here.</p>'
                   for i, c in enumerate(["lead", "legal", "banner-lead", "related-work", "share", "social", "response"]))
    page = f'<nav class="menu"><a href=/>Home</a></nav><article><h1>Title of it</h1>{body}<div class="share"><a href=x>Share this</a></div></article><div class="legal">Terms of use apply</div>'
    text = he.main_text(page, WEIGHT)
    assert all(f"number {i} of" in text for i in range(7))
    assert "Share this" not in text and "Terms" not in text and "Home" not in text
    hidden = he.main_text('<article><p>Shown words of the text here.</p><p hidden class="legal">Not shown at all.</p></article>', WEIGHT)
    assert "Shown" in hidden and "Not shown" not in hidden
