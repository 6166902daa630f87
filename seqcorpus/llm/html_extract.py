"""Main text of HTML pages by the maximum-scoring subsequence of words and tags (operator 1).

A page becomes a sequence of tags and runs of words; a linear scan finds the contiguous stretch of the
greatest sum, where words of content kinds score above zero, words of other kinds and all tags below.  A
word's kind is its block element, whether it is in a link, and whether an enclosing element names itself as
something beside the article (navigation, advert, form, reader comments, ...); such an element costs its tags
and one word, however long, so that one within the article doesn't split it.  The names are evidence only: html, body, and elements that turn out
to hold the article (:func:`marks`) are not beside it.  Weights are learned from
labelled pages, those whose markup has exactly one <article> or <main>: a word kind weighs the log odds of
lying inside it, a tag the log probability.  Counts come from a bounded sample of pages (``sample_pages``) on
top of a small prior.  The text of the stretch, without the words of those other elements, is the result.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space in page order; block elements and <br> end a block, other elements don't.  Scripts,
styles, titles, comments in the markup and other raw elements are no words.

Defined cases: a null or empty page, or one without words, gives an empty text; pages of equal scores give the
first, shortest stretch; broken markup is read as far as it goes (an unclosed comment or script ends the page);
repeated rows give equal results; an empty table gives an empty result; extra columns pass through
:func:`extract`, a column named as an output is replaced.  Pages are read whole, in three passes that are linear
in their length, however deep their elements are nested.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard by role.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg math canvas object select".split())
BESIDE = frozenset("nav aside footer form header menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Parts of class, id and role names that sites give to what is not the article.
BESIDE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies discussion disqus footer form header legal masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
# Elements that are never a frame around the page.
NO_FRAME = frozenset("nav aside footer menu dialog button".split())
# Elements that hold text of the article, whatever their class is called.
TEXTUAL = HEADINGS | frozenset("p blockquote pre figure figcaption table".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

#: Word kinds and tags seen in no sample: counts (inside, outside) that stand for common markup.
PRIOR = {"w:p": (3, 0.5), "w:h1": (1.5, 1), "w:li": (1, 1.5), "w:beside": (0.5, 4), "w:link": (1, 1),
         "t:p": (5, 0.5), "t:/p": (5, 0.5), "t:br": (3, 0.5), "t:b": (3, 0.5), "t:/b": (3, 0.5), "t:i": (3, 0.5), "t:/i": (3, 0.5)}
LIMIT, BESIDE_LIMIT = 4.0, 2.0


def _beside(name: str, attributes: str) -> frozenset[str]:
    """What speaks for an element beside the article: its tag, that it is hidden, or parts of its names."""
    if name in ("html", "body") or name in CONTENT:
        return frozenset()
    if name in BESIDE:
        return frozenset((f"<{name}>",))
    if HIDDEN.search(attributes):
        return frozenset(("hidden",))
    if "=" not in attributes:
        return frozenset()
    parts = (NAME_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower()) for _, a, b, c in NAMED.findall(attributes))
    return BESIDE_NAMES.intersection(*[{x for p in parts for x in p}])


def events(page: str):
    """(tag name, closing, attributes) and (None, text, None) in page order."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield None, page[at:], None
            return
        if lt > at:
            yield None, page[at:lt], None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) or PLAIN_TAG.match(page, lt)
        if m is None:
            if page.startswith("</", lt) or lt + 1 < size and page[lt + 1].isalpha() and page.find(">", lt) < 0:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield None, "<", None
                at = lt + 1
            continue
        name, closing = m[2].lower(), bool(m[1])
        at = m.end()
        if name in RAW and not closing and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end is None:
                return
            close = page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        yield name, closing, m[3]


class _Open:
    """The open elements, innermost last, as (name, value); an end tag that no element has costs nothing."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.names: dict[str, int] = {}

    def push(self, name: str, value) -> None:
        self.stack.append((name, value))
        self.names[name] = self.names.get(name, 0) + 1

    def pop(self) -> tuple:
        out = self.stack.pop()
        self.names[out[0]] -= 1
        return out

    def close(self, name: str) -> list[tuple]:
        """Take off the elements that an end tag closes."""
        out = []
        while self.names.get(name):
            out.append(self.pop())
            if out[-1][0] == name:
                break
        return out

    def ended_by(self, name: str) -> bool:
        """Whether a start tag ends the innermost open element."""
        return bool(self.stack) and (name == "p" and self.stack[-1][0] in HEADINGS | {"p"} or name == "li" and self.stack[-1][0] == "li")


def marks(found: list[tuple]) -> tuple[set[int], list[int]]:
    """Places of the start tags of elements beside the article, and of those that could be frames, outermost first.

    A mark that would hide the article is no mark.  It is taken back from elements around <main>, or around an
    <article> when no article is outside of marks (several articles in a marked element of less than half of
    the words are a list of comments or cards); without these, from elements with the <h1> and most words of
    the page; and from one that is only called a header and holds the <h1>.  A paragraph, heading, quotation,
    figure or table within the article is none by its names alone.  Frames are marked elements with most words of the page:
    they lie within one another."""
    stack = _Open()  # block or marked elements; the value is the innermost marked place, the element itself included
    why: dict[int, frozenset[str]] = {}
    above: dict[int, int | None] = {}  # the marked element around a marked element
    deep: dict[int | None, int] = {None: 0}
    words: dict[int, int] = {}
    titled: set[int] = set()
    holders: dict[str, list[tuple[int, int | None]]] = {}
    total = depth = 0

    def leave(out: list[tuple]) -> None:
        for _, (k, own) in out:
            if own:
                words[k] = total - words[k]

    def around(k: int | None, into: set[int]) -> None:
        while k is not None and k not in into:
            into.add(k)
            k = above[k]

    for i, (name, closing, rest) in enumerate(found):
        if name is None:
            total += len(closing.split())
            continue
        if closing:
            out = stack.close(name)
            leave(out)
            depth -= sum(n in CONTENT for n, _ in out)
            continue
        inner = stack.stack[-1][1][0] if stack.stack else None
        if name == "h1":
            around(inner, titled)
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if stack.ended_by(name):
            leave([stack.pop()])
            inner = stack.stack[-1][1][0] if stack.stack else None
        if name in CONTENT:
            if not depth:
                holders.setdefault(name, []).append((deep[inner], inner))
            depth += 1
        # a header within the article is its title
        own = frozenset() if name == "header" and depth else _beside(name, rest)
        if depth and name in TEXTUAL and "hidden" not in own:
            own = frozenset()
        if own:
            why[i], words[i], above[i], deep[i] = own, total, inner, deep[inner] + 1
        if name in BLOCKS or own:
            stack.push(name, (i if own else inner, bool(own)))
    leave([stack.pop() for _ in range(len(stack.stack))])
    most = {k for k in why if 2 * words[k] > total}
    back = {k for k in titled if why[k] == {"header"}}
    for kind in ("main", "article"):
        if kind in holders:
            least = min(n for n, _ in holders[kind])
            chosen = [k for n, k in holders[kind] if n == least]
            held: set[int] = set()
            for k in chosen:
                around(k, held)
            back.update(held if kind == "main" or len(chosen) == 1 else most & held)
            break
    can = sorted(k for k in most - back if found[k][0] not in NO_FRAME and "hidden" not in why[k])
    if not holders:
        back.update(titled.intersection(can))
        can = [k for k in can if k not in titled]
    return why.keys() - back, can


def frames_needed(found: list[tuple], beside_at: set[int], can: list[int], weight) -> int:
    """How many of the frames, from the outermost, must be no marks for some word of the page to count for the article."""
    place = {k: n + 1 for n, k in enumerate(can)}
    stack, link, best = _Open(), 0, math.inf  # the value: frames that must go for a word here to be outside of marks
    for i, (name, closing, rest) in enumerate(found):
        if name is None:
            need = stack.stack[-1][1] if stack.stack else 0
            if need < best and not closing.isspace():
                kind = "w:link" if link else "w:" + (stack.stack[-1][0] if stack.stack else "body")
                if weight(kind) > 0 and not (html.unescape(closing) if "&" in closing else closing).isspace():
                    best = need
                    if not best:
                        return 0
            continue
        if name == "a":
            link = 0 if closing else 1
        if closing:
            stack.close(name)
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if stack.ended_by(name):
            stack.pop()
        if name in BLOCKS or i in beside_at:
            outer = stack.stack[-1][1] if stack.stack else 0
            stack.push(name, max(outer, place.get(i, math.inf)) if i in beside_at else outer)
    return len(can) if best == math.inf else int(best)


def sequence(page: str, found: list[tuple] | None = None, beside_at: set[int] | None = None) -> list[tuple]:
    """Items in page order: ("tag", key, inside) and ("text", kind, inside, text, block number, beside).

    ``inside`` says whether the item lies in an <article> or <main>."""
    found = list(events(page)) if found is None else found
    beside_at = marks(found)[0] if beside_at is None else beside_at
    out, stack = [], _Open()  # block or beside elements; the value is whether the element is beside
    block, link, depth, beside, told = 0, 0, 0, 0, False  # told: this beside element has had its word
    for i, (name, closing, rest) in enumerate(found):
        if name is None:
            text = html.unescape(closing) if "&" in closing else closing
            kind = "in" if told else "w:beside" if beside else "w:link" if link else "w:" + (stack.stack[-1][0] if stack.stack else "body")
            told = told or beside > 0 and not text.isspace()
            out.append(("text", kind, depth > 0, text, block, beside > 0))
            continue
        if name in BLOCKS:
            block += 1
        if name == "a":
            link = 0 if closing else 1
        content = name in CONTENT
        if closing:
            for n, b in stack.close(name):
                beside -= b
                depth -= n in CONTENT
            out.append(("tag", "in" if told and beside else f"t:/{name}", depth > 0 or content))
            told = told and beside > 0
        else:
            out.append(("tag", "in" if told else f"t:{name}", depth > 0 or content))
            if name in VOID or rest.rstrip().endswith("/"):
                continue
            if stack.ended_by(name):
                beside -= stack.pop()[1]
            own = int(i in beside_at)
            if name in BLOCKS or own:
                stack.push(name, own)
                beside += own
                depth += content
    return out


def region(items: list[tuple], weight) -> tuple[int, int]:
    """Places (first, end) of the maximum-scoring contiguous stretch; (0, 0) if nothing scores above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(items):
        score = weight(item[1])
        if item[0] == "text" and not item[5]:
            score *= len(item[3].split())
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best + 1e-9:
            best, found = total, (start, i + 1)
    return found


def weights(counts: dict[str, tuple[float, float]]):
    """Weight function: log odds of word kinds, log probability of tags, within +-LIMIT."""
    known = {}
    for key in {*counts, *PRIOR}:
        a, b = (x + y for x, y in zip(counts.get(key, (0, 0)), PRIOR.get(key, (0.5, 0.5)), strict=True))
        odds = math.log((a + 0.05) / (b + 0.05))
        known[key] = max(-LIMIT, min(LIMIT, odds)) if key.startswith("w:") else max(-LIMIT, -math.log1p(math.exp(-odds)))
    known["in"], known["w:beside"] = 0.0, max(-BESIDE_LIMIT, min(-0.5, known["w:beside"]))
    return lambda key: known.get(key, 0.5 if key.startswith("w:") else -0.7)


def main_text(page: str | None, weight) -> str:
    if not page:
        return ""
    found = list(events(page))
    beside_at, can = marks(found)
    # a page with nothing outside of marked elements: the outermost large ones are frames
    items = sequence(page, found, beside_at - set(can[:frames_needed(found, beside_at, can, weight)]))
    first, end = region(items, weight)
    blocks: dict[int, list[str]] = {}
    for item in items[first:end]:
        if item[0] == "text" and not item[5]:
            blocks.setdefault(item[4], []).append(item[3])
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t)


def learn(pages: DataFrame, sample_pages: int = 2000, column: str = "html", key: str = "page_id") -> dict[str, tuple[float, float]]:
    """Counts (inside, outside) of word kinds and tags over the labelled pages of a bounded sample: the
    ``sample_pages`` smallest hashes of the key.  A page counts as much as any other, however long."""
    sample = pages.select(F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(sample_pages).select(key).distinct()
    chosen = pages.select(key, column).join(F.broadcast(sample), key)

    def task(batches):
        for batch in batches:
            total: dict[str, list[float]] = {}
            for page in batch.column(1).to_pylist():
                items = sequence(page or "")
                if sum(i[0] == "tag" and i[1] in ("t:article", "t:main") for i in items) != 1:
                    continue
                own: dict[str, list[float]] = {}
                for item in items:
                    if item[1] == "in":
                        continue
                    n = len(item[3].split()) if item[0] == "text" else 1
                    own.setdefault(item[1], [0, 0])[0 if item[2] else 1] += n
                for k, (a, b) in own.items():
                    x = total.setdefault(k, [0, 0])
                    x[0] += a / (a + b) if a + b else 0
                    x[1] += b / (a + b) if a + b else 0
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x[0] for x in total.values()], pa.float64()),
                                              pa.array([x[1] for x in total.values()], pa.float64())], names=["k", "a", "b"])

    got = chosen.mapInArrow(task, "k string, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return {r.k: (r.a, r.b) for r in got.orderBy(F.desc(F.col("a") + F.col("b")), "k").limit(1000).collect()}


def extract(pages: DataFrame, counts: dict[str, tuple[float, float]], column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html column and with ``out`` (text) and ``n_chars``."""
    names = [f for f in pages.schema if f.name not in (column, out, "n_chars")]
    schema = T.StructType([*names, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def task(batches):
        weight = weights(counts)
        for batch in batches:
            texts = [main_text(p, weight) for p in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(task, schema)
