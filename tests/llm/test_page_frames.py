"""Operator 1: frames of the page that are named like something beside the article don't hide it."""

import pytest

from seqcorpus.llm import html_extract

ARTICLE = "<article><h1>The title of this long text</h1><p>One long paragraph of real text here.</p><p>And another one of them.</p></article>"
PLAIN = "<h1>The title of this long text</h1><p>One long paragraph of real text here.</p><p>And another one of them.</p>"
TEXT = "The title of this long text One long paragraph of real text here. And another one of them."
COMMENTS = "<div id=comments><p>Great post, thanks for writing.</p><article><p>Another comment by a reader of this.</p></article><article><p>More of it, much more of it.</p></article></div>"


def _text(page):
    return html_extract.main_text(page, html_extract.weights({}))


@pytest.mark.parametrize("before,after", [
    ("<body class='single has-sidebar'>", "</body>"), ("<html class=no-sidebar><body>", "</body></html>"),
    ("<body><div id='page' class='with-header'>", "</div></body>"), ("<body><form id='aspnetForm'>", "</form></body>"),
    ("<form><div class=with-header>", "</div></form>"), ("<body><div class='search-page' style='display: none'>", "</div>")])
@pytest.mark.parametrize("nav", ["", "<nav><ul><li><a href=/>Home</a></ul></nav>"])
def test_frames_around_an_article(before, after, nav):
    assert _text(before + nav + ARTICLE + "<footer>foot of it</footer>" + after) == TEXT
    assert _text(before + nav + ARTICLE.replace("article", "main") + COMMENTS + after) == TEXT
    assert _text(before + nav + ARTICLE + COMMENTS + after) == TEXT


@pytest.mark.parametrize("before,after", [
    ("<body class='has-sidebar'>", ""), ("<form id='aspnetForm'>", "</form><div>&copy; example</div>"), ("<div id=page class=with-header>", "</div>")])
def test_frames_around_plain_text(before, after):
    page = before + "<nav><a href=/>Home</a></nav><div id=content>" + PLAIN + "</div><div class=comments><p>Great post.</p></div>" + after
    assert _text(page) == TEXT
    no_title = page.replace("<h1>The title of this long text</h1>", "").replace("<div>&copy; example</div>", "")
    assert _text(no_title) == TEXT.removeprefix("The title of this long text ")


def test_title_in_a_header_of_the_post():
    title = "<h1>The title of this long text</h1>"
    head = f"<div class='post-header'>{title}</div>"
    assert _text("<body>" + ARTICLE.replace(title, head)) == TEXT
    assert _text("<body><div id=content>" + PLAIN.replace(title, head) + "</div>") == TEXT


def test_other_elements_stay_beside():
    assert _text("<body>" + ARTICLE + COMMENTS) == TEXT
    assert _text("<body><div id=content>" + PLAIN + "</div><div id=comments>" + "<p>Great post, thanks for writing.</p>" * 20 + "</div>") == TEXT
