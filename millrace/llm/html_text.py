"""Main text of web pages: flat text blocks and a decision tree on words and link density.

A page is scanned once, forwards, into text blocks (runs between block-level tags).  A block
has its word count and link density, those of the blocks before and after it, and one hint:
1 inside an ``article`` or ``main`` element, -1 where an element around it says that it is
text of another kind (reader comments, advert, notice, form, sidebar, footer, hidden), 0 where
nothing is known.  Menus, headers, bread crumbs and lists of links have no hint; inside an
article they lose theirs.  A decision tree, trained on the small labelled table below,
decides which blocks stay: by link density first, then by words and the neighbours' density,
and by the hint where those leave it open.

Scanning takes time in proportion to the page, whatever is unclosed in it.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.boosting import Forest, decision_tree
from millrace.llm.common import in_slices

#: Elements whose content is raw text, up to the first end tag or else the page's end.
_RAW = frozenset("script style title iframe textarea noembed noframes xmp".split())
#: Elements that nest, whose content is no text of the page; without an end tag they hold nothing.
_SILENT = frozenset("template svg math object canvas select button audio video".split())
_FOREIGN = frozenset(("svg", "math"))  # only they, and tags within them, may close themselves
_STOP = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE) for n in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles of text that is not the article's.
_OTHER = frozenset("footer aside form dialog noscript search".split())
_OTHER_ROLES = frozenset("contentinfo complementary search form dialog alertdialog alert".split())
#: Elements and roles of links, which words and density tell.
_LINKS = frozenset("nav menu header".split())
_LINK_ROLES = frozenset("navigation banner menu menubar toolbar directory".split())
#: Parts of class and id names that mark text that is not the article's.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr hidden modal newsletter notice notices notification overlay popup promo promos promotion recommended reply respond "
    "sidebar sidebars signup sponsor sponsored subscribe subscription warning widget widgets".split()
)
#: Parts of class and id names that mark links.
_LINK_MARKS = frozenset(
    "breadcrumb breadcrumbs header login masthead menu menus nav navbar navigation pager pagination related share sharing shares skip social toc toolbar".split()
)
#: Parts of names that mark the article, whatever else the name says.
_OURS = frozenset("article content main post entry story has with without no page site".split())
#: Whole class names that mark also inside of the article, of either kind.
_PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot comment comments commentlist comment-list comments-area comment-respond "
    "cookie-banner cookie-notice disqus hidden modal newsletter popup promo promos promotion recommended related-articles related-posts respond "
    "sidebar sidebars signup sponsor sponsored subscribe subscription widget widgets".split()
)
_PLAIN_LINKS = frozenset("breadcrumb breadcrumbs login masthead menu menus nav navbar navigation pager pagination share share-buttons sharing social-share toc toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

#: Labelled blocks (fixed values): words, link density, the same of the block before and after
#: (-1 words: none), hint, label (1 main text).
_LABELLED = """
1 1.0 -1 0.0 1 1.0 0 0
1 1.0 1 1.0 1 1.0 0 0
2 1.0 1 1.0 2 1.0 0 0
1 1.0 2 1.0 8 0.0 0 0
3 1.0 6 0.0 3 1.0 0 0
4 1.0 40 0.0 4 1.0 0 0
6 1.0 5 0.8 -1 0.0 0 0
2 1.0 1 1.0 60 0.0 0 0
5 0.8 3 0.0 5 0.8 0 0
25 0.9 25 0.9 25 0.9 0 0
12 0.7 12 0.7 2 1.0 0 0
30 0.7 4 1.0 -1 0.0 0 0
3 0.6 -1 0.0 1 1.0 0 0
8 0.6 1 1.0 9 0.6 0 0
1 1.0 -1 0.0 2 1.0 0 0
2 1.0 1 1.0 1 1.0 0 0
3 1.0 2 1.0 -1 0.0 0 0
2 0.5 2 1.0 1 1.0 0 0
4 0.5 6 1.0 5 1.0 0 0
10 1.0 8 1.0 12 1.0 0 0
7 0.9 30 0.0 6 0.9 0 0
1 1.0 9 0.0 -1 0.0 0 0
2 1.0 3 1.0 3 1.0 0 0
5 1.0 7 0.8 4 1.0 0 0
15 0.8 14 0.8 13 0.9 0 0
1 1.0 12 0.0 1 1.0 0 0
6 1.0 60 0.0 50 0.0 0 1
9 0.8 80 0.0 40 0.1 0 1
5 1.0 30 0.0 45 0.0 0 1
2 0.0 -1 0.0 1 1.0 0 0
3 0.0 -1 0.0 2 1.0 0 0
6 0.0 1 1.0 1 1.0 0 0
2 0.0 1 1.0 1 1.0 0 0
5 0.0 3 1.0 4 1.0 0 0
7 0.1 2 1.0 3 0.9 0 0
4 0.0 1 1.0 6 0.0 0 0
8 0.0 1 1.0 7 0.0 0 0
5 0.0 1 1.0 9 0.0 0 0
7 0.0 2 1.0 3 0.0 0 0
3 0.0 5 1.0 -1 0.0 0 0
8 0.0 2 1.0 -1 0.0 0 0
5 0.2 4 0.9 -1 0.0 0 0
2 0.0 8 0.0 1 1.0 0 0
4 0.0 3 0.0 2 1.0 0 0
6 0.0 1 1.0 60 0.0 0 1
9 0.0 1 1.0 45 0.0 0 1
4 0.0 2 1.0 30 0.0 0 1
5 0.0 60 0.0 1 1.0 0 1
3 0.0 40 0.0 2 1.0 0 1
60 0.0 12 0.0 45 0.0 0 1
45 0.1 60 0.0 2 0.0 0 1
40 0.2 1 1.0 60 0.0 0 1
25 0.0 60 0.0 1 1.0 0 1
18 0.0 1 1.0 50 0.0 0 1
30 0.3 50 0.1 20 0.0 0 1
15 0.4 20 0.0 200 0.0 0 1
200 0.0 -1 0.0 -1 0.0 0 1
100 0.0 1 1.0 1 1.0 0 1
40 0.0 1 1.0 2 1.0 0 1
16 0.0 3 1.0 2 1.0 0 1
22 0.1 4 1.0 -1 0.0 0 1
8 0.0 2 0.0 60 0.0 0 1
3 0.0 40 0.0 50 0.0 0 1
1 0.0 60 0.0 30 0.0 0 1
1 0.0 1 0.0 1 0.0 0 1
2 0.0 3 0.0 2 0.0 0 1
5 0.0 6 0.0 8 0.0 0 1
1 0.0 -1 0.0 -1 0.0 0 1
3 0.0 -1 0.0 -1 0.0 0 1
2 0.0 -1 0.0 6 0.0 0 1
6 0.0 -1 0.0 60 0.0 0 1
1 0.0 5 0.0 -1 0.0 0 1
2 0.0 60 0.0 -1 0.0 0 1
12 0.0 -1 0.0 9 0.0 0 1
35 0.0 20 0.0 70 0.0 0 1
90 0.1 35 0.0 15 0.0 0 1
14 0.0 90 0.0 120 0.1 0 1
28 0.0 4 0.0 33 0.0 0 1
50 0.2 28 0.0 -1 0.0 0 1
10 0.2 12 0.0 14 0.0 0 1
1 1.0 1 1.0 1 1.0 1 1
4 1.0 1 1.0 60 0.0 1 1
1 1.0 12 0.0 45 0.0 1 1
2 1.0 60 0.0 30 0.0 1 1
7 0.7 8 0.0 5 0.8 1 1
2 0.0 1 1.0 1 1.0 1 1
5 0.0 1 1.0 -1 0.0 1 1
1 0.0 6 0.0 1 1.0 1 1
6 0.0 3 0.0 6 0.5 1 1
8 0.0 2 0.0 5 0.6 1 1
6 0.0 1 1.0 4 0.0 1 1
3 0.0 -1 0.0 1 1.0 1 1
1 0.0 1 0.0 8 0.0 1 1
60 0.0 50 0.0 40 0.0 -1 0
25 0.2 60 0.0 30 0.1 -1 0
2 0.0 60 0.0 60 0.0 -1 0
8 0.0 1 1.0 60 0.0 -1 0
1 0.0 1 0.0 1 0.0 -1 0
"""
_FEATURES = 7


@lru_cache(maxsize=1)
def tree() -> Forest:
    rows = np.array([line.split() for line in _LABELLED.strip().splitlines()], float)
    return decision_tree(rows[:, :_FEATURES], rows[:, _FEATURES], depth=8)


def _hint(name: str, rest: str, now: int) -> int:
    """The hint inside an element, ``now`` around it."""
    return _small_hint(name, rest, now) if len(rest) < 200 else _any_hint(name, rest, now)


def _any_hint(name: str, rest: str, now: int) -> int:
    if now < 0 or name in _OTHER:
        return -1
    links = name in _LINKS and not (name == "header" and now > 0)
    named = name not in ("html", "body", "main", "article")
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            if value.lower() in _OTHER_ROLES:
                return -1
            links |= value.lower() in _LINK_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return -1
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return -1
        elif key in ("class", "id") and named:
            for token in value.split():
                if now > 0:
                    if key == "class" and token.lower() in _PLAIN:
                        return -1
                    links |= key == "class" and token.lower() in _PLAIN_LINKS
                    continue
                parts = [p.lower() for p in _NAME_PARTS.split(token) if p]
                if not parts or _OURS.intersection(parts):
                    continue
                if key == "id":  # a slug is the text of a heading: all of its words have to be marks
                    if name not in _HEADINGS and all(p in _MARKS or p.isdigit() for p in parts):
                        return -1
                elif parts[0] in _MARKS or parts[-1] in _MARKS:
                    return -1
                links |= parts[0] in _LINK_MARKS or parts[-1] in _LINK_MARKS
    if links:
        return 0
    return 1 if name in ("article", "main") else now


_small_hint = lru_cache(maxsize=20_000)(_any_hint)


class _Open:
    """The open elements, and how many of each name, so that a stray end tag costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str, value: int) -> None:
        self.stack.append((name, value))
        self.count[name] += 1

    def pop(self) -> tuple[str, int]:
        out = self.stack.pop()
        self.count[out[0]] -= 1
        return out

    def top(self) -> tuple[str, int]:
        return self.stack[-1] if self.stack else ("", 0)

    def close(self, name: str) -> int | None:
        """Pop through the innermost element of that name; its value, or none if it isn't open."""
        if not self.count[name]:
            return None
        while True:
            found, value = self.pop()
            if found == name:
                return value


class _Reader:
    """The blocks of one page."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, int]] = []  # text, words, linked words, hint
        self.open = _Open()  # with the hint
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.links = 0

    def text(self, s: str) -> None:
        self.parts.append(s)
        if self.links:
            self.linked.append(s)

    def cut(self) -> None:
        if self.parts:
            words = _html.unescape("".join(self.parts)).split()
            if words:
                linked = len(_html.unescape("".join(self.linked)).split()) if self.linked else 0
                self.blocks.append((" ".join(words), len(words), min(linked, len(words)), self.open.top()[1]))
            self.parts, self.linked = [], []

    def start(self, name: str, rest: str) -> None:
        block = name in _BLOCK
        if block:
            self.cut()
            self.links = 0 if name in ("p", "li", "div") else self.links
            while self.open.top()[0] == "p":
                self.open.pop()
        if name == "a":
            self.links += 1
        elif name == "br":
            self.text(" ")
        if name in _VOID:
            return
        if name == "body":
            self.open.close("head")
        now = self.open.top()[1]
        hint = _hint(name, rest, now)
        if hint != now or (block and name not in ("p", "html")):
            if not block:
                self.cut()
            self.open.push(name, hint)

    def end(self, name: str) -> None:
        if name in _BLOCK:
            self.cut()
        if name == "a":
            self.links = max(0, self.links - 1)
        if self.open.count[name]:
            self.cut()
            self.open.close(name)


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag ends whose name ends at ``at``, or -1; ``lost`` collects quotes that the rest of the page lacks."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] != "=" or m[0] in lost:  # a quote that opens no value
            continue
        close = page.find(m[0], at)
        if close < 0:
            lost.add(m[0])
        else:
            at = close + 1
    return -1


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, rest) of all markup in order; without a name: a comment or the like.

    Markup that the page's end cuts takes the rest of the page.
    """
    out, foreign, lost = [], 0, set()
    n, at = len(page), page.find("<")
    while 0 <= at < n:
        start, name, end, rest = at, "", page.startswith("</", at), ""
        m = _NAME.match(page, at + 1 + end)
        if m:
            at = _tag_end(page, m.end(), lost)
            name, rest = m[0].lower(), page[m.end() : at - 1] if at >= 0 else ""
        elif page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            at = at + 3 if at >= 0 else -1
        elif end or page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1 or -1
        else:  # a mere sign
            at = page.find("<", at + 1)
            continue
        if at < 0:
            out.append((start, n, "", False, ""))
            break
        if end:
            foreign -= name in _FOREIGN and foreign > 0
        elif name in _FOREIGN:
            foreign += not rest.endswith("/")
        elif name in _RAW and not (foreign and rest.endswith("/")):
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            name = ""
        out.append((start, at, name, end, rest))
        at = page.find("<", at)
    return out


def _silent(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Start tag and end tag, by place in ``tags``, of silent elements that end within the element around them."""
    found, open_ = {}, _Open()
    for i, (_, _, name, end, rest) in enumerate(tags):
        if name not in _SILENT and (name not in _BLOCK or name in _VOID):
            continue
        if not end:
            if name in _BLOCK and open_.top()[0] == "p":
                open_.pop()
            if not (name in _FOREIGN and rest.endswith("/")):
                open_.push(name, i)
            continue
        begin = open_.close(name)
        if begin is not None and name in _SILENT:
            found[begin] = i
    return found


def blocks(page: str) -> _Reader:
    r, at, tags = _Reader(), 0, _tags(page)
    silent = _silent(tags) if any(t[2] in _SILENT for t in tags) else {}
    i = 0
    while i < len(tags):
        start, stop, name, end, rest = tags[i]
        if start > at:
            r.text(page[at:start])
        if i in silent:
            i = silent[i]
            stop = tags[i][1]
        elif name and name not in _SILENT:
            if end:
                r.end(name)
            else:
                r.start(name, rest)
        at = stop
        i += 1
    if at < len(page):
        r.text(page[at:])
    r.cut()
    return r


def features(r: _Reader) -> np.ndarray:
    n = len(r.blocks)
    x = np.zeros((n, _FEATURES))
    if n:
        words = np.array([b[1] for b in r.blocks], float)
        density = np.array([b[2] for b in r.blocks], float) / words
        x[:, 0], x[:, 1] = words, density
        x[:, 2], x[:, 3] = np.append(-1, words[:-1]), np.append(0, density[:-1])
        x[:, 4], x[:, 5] = np.append(words[1:], -1), np.append(density[1:], 0)
        x[:, 6] = [b[3] for b in r.blocks]
    return x


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page: kept blocks, one a line."""
    read = [blocks(p) for p in pages]
    x = [features(r) for r in read]
    keep = tree().raw(np.concatenate(x)) >= 0.5 if x else np.zeros(0, bool)
    out, at = [], 0
    for r in read:
        out.append("\n".join(b[0] for b, k in zip(r.blocks, keep[at : at + len(r.blocks)]) if k))
        at += len(r.blocks)
    return out


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null and empty pages have the empty text.  White space in a block becomes one space;
    blocks stand in page order, one a line; nothing else is dropped or cut.  Long pages are
    read whole.  Repeated rows, and rows that tie in id, give a row each; other columns are
    not read, whatever their names; an empty table gives no rows.
    """

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts([x or "" for x in b.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(
        in_slices(make), "page_id long, url string, text string, n_chars long"
    )
