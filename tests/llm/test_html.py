"""Main texts: elements, hints, density, an independent extractor, and hostile pages."""

import html
import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from millrace.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_html():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><!-- x --><div class="ad">Buy now</div>'
        "<article><h1>Head &amp; line</h1><p>One  two\nthree<br>four<p>Five &lt;six&gt;</p><div class='comments'><p>I agree wholeheartedly</p></div></article>"
        '<aside>Side</aside><form><p>Name</p></form><footer>&copy; me</footer>'
    )
    assert html_text.main_texts([page, "", "plain"]) == ["Head & line\nOne two three four\nFive <six>", "", "plain"]
    assert html.unescape("&am") == "&am"


def test_html_elements_that_nest_or_stay_open():
    pages = {
        '<article><p>One <svg class="i"/> two</p><p>Three</p></article><footer>x</footer><svg><path/></svg>': "One two\nThree",
        "<article><p>One <svg><svg>a</svg><title/>b</svg>two <math/>three</p></article>": "One two three",
        "<article><object>a<object>b</object>c</object><p>Kept text</p></article>": "Kept text",
        "<article><p>One</p><div><button>Go</div><p>Two</p><audio><p>Three</p></article>": "One\nGo\nTwo\nThree",
        "<article><p>One <button>Go</button>two <select><option>a<option>b</select>three</p></article>": "One two three",
        "<article><p>One</p><script>if (a < b) '</p>'</script><p>Two</p><script>open": "One\nTwo",
    }
    assert html_text.main_texts(list(pages)) == list(pages.values())


def test_html_names_and_values_that_mark_nothing():
    body = (
        '<h2 id="related-work">Related work</h2><section id="search-algorithms"><p>On search</p></section><div id="hidden-markov-models"><p>On models</p></div>'
        '<div class="section-header"><p>Of a section with a header</p></div><p>See <a href="/hidden/places">places</a> and <a title="the hidden cost">cost</a></p><div data-role="menu" data-class="ad"><p>Data</p></div>'
    )
    want = "Related work\nOn search\nOn models\nOf a section with a header\nSee places and cost\nData"
    drop = '<div class="ad"><p>Buy</p></div><div role=menu><a href="#">Menu</a></div><div class="x related-posts"><p>More</p></div><p hidden>H</p><div aria-hidden="true"><p>A</p></div><div style="display:none">S</div>'
    assert html_text.main_texts([f"<article>{body}{drop}</article>", f"<main>{body}</main>"]) == [want, want]
    long = "a text of some length that any reader would call the main text of this page"
    page = f'<h2 id="related-work">Related</h2><p>{long}</p><section id="search-algorithms"><p>{long}</p></section><div id="cookie-banner"><p>{long}</p></div>'
    assert html_text.main_texts([page]) == [f"Related\n{long}\n{long}"]



def test_density_of_neighbours_decides_without_any_hint():
    story = "a text of some length that any reader would call the main text of this page"
    menu = "".join(f'<div><a href="/{k}">Part {k}</a></div>' for k in range(6))
    page = f"<body><p>Site name</p>{menu}<h1>What happened</h1><p>{story}</p><p>Short.</p><p>{story}</p><div><a href=x>More</a></div><div>Try also</div><div><a href=y>Other</a></div></body>"
    assert html_text.main_texts([page]) == [f"What happened\n{story}\nShort.\n{story}"]


class Second(HTMLParser):
    """The text inside article, by the standard library's parser; breaks at block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in ("p", "h1", "li", "div", "article"):
            self.parts.append("\n")
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "div", "article"):
            self.parts.append("\n")
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(re.sub(r"\s+", " ", data))

    def text(self):
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql(f"select html from '{PAGES}' order by page_id").fetchall()]


def test_against_a_second_extractor(pages):
    same = 0
    for page, got in zip(pages, html_text.main_texts(pages)):
        second = Second()
        second.feed(page)
        second.close()
        same += second.text() == got
    assert same >= 0.99 * len(pages)


def test_words_and_density_decide(pages):
    x = np.concatenate([html_text.features(html_text.blocks(p)) for p in pages])
    tree = html_text.tree()
    kept = tree.raw(x) >= 0.5
    assert tree.feature[tree.roots[0]] in (1, 3, 5)
    for columns, least in (((1, 3, 5), 0.2), ((0, 1, 2, 3, 4, 5), 0.2)):
        erased = x.copy()
        erased[:, columns] = 0
        assert ((tree.raw(erased) >= 0.5) != kept).mean() > least


HOSTILE = {
    "tags without end": "<a " * 60_000, "quotes without end": '<p a="' * 60_000, "comments without end": "<!--" * 60_000, "scripts without end": "<script>" * 60_000,
    "deep": "<div>" * 60_000 + "</section>" * 60_000, "bodies": "<head>" + "<div><body>" * 40_000, "marks": "< " * 60_000, "ends": "</x" * 60_000, "spaces": "<p " + " \"" * 60_000 + ">",
    "attributes": "<p " + "a='x " * 60_000 + ">", "silent": "<svg>" * 40_000 + "</math>" * 40_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    page = HOSTILE[name]
    began = time.process_time()
    html_text.main_texts([page, f"<article><p>before</p>{page}"])
    assert time.process_time() - began < 4


def test_rows(spark):
    rows = [(1, "u", "<p>One</p>", "x", 5), (1, "u", "<p>One</p>", "x", 5), (None, None, None, None, None), (3, "v", "", "t", 1), (4, "w", "<p>" + "long text " * 200_000, "t", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in got) == [(0, "", 0), (1, "One", 3), (1, "One", 3), (3, "", 0), (4, "long text", 1_999_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_fits_its_table():
    rows = np.array([line.split() for line in html_text._LABELLED.strip().splitlines()], float)
    assert ((html_text.tree().raw(rows[:, :-1]) >= 0.5) == rows[:, -1]).all()
