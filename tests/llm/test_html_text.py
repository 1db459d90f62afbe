import time

import pytest

from relcheck.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>The Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>
<aside>Side words</aside><div id="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>First   para<b>graph</b> &copy; it.<p>Second<br>line &#8212; &lt;ok&gt;<div class="advert box">Ad inside</div><form><input name=q><p>Search</form><p>x</p>
<section class="comments"><article><p>I disagree</p></article></section></article><footer>Foot</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == "Head&line First paragraph © it. Second line — <ok> x"


def test_without_article_mark():
    body = "<body><div>Home | <a href=/x>About us</a> | <a href=/y>Contact</a></div><div><p>" + "Long sentence of the story. " * 5 + "</p><p>Short.</p></div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></body>"
    assert main_text(body) == ("Long sentence of the story. " * 5).strip() + " Short."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain words", "plain words"),
        ("<article>cut <b>off", "cut off"),
        ("<article>a <p>b</p> <!-- unclosed", "a b"),
        ("<article>a &am", "a &am"),
        ("<article>a < b &nbsp; c</article>", "a < b c"),
        ('<article>x<a href="unclosed>y</a></article>', "xy"),
        ("<article><script>if (a</b) {}</script>text</article><script>never closed", "text"),
        ("<main><p>in main</p></main><p>out</p>", "in main"),
        ("<article><p class=ad>ad text<p>kept</article>", "kept"),
        ('<article><div style="display:none">hidden</div><div hidden>gone</div>seen</article>', "seen"),
        ("<ARTICLE><P>UPPER</P></ARTICLE>", "UPPER"),
    ],
)
def test_edges(page, want):
    assert main_text(page) == want


def test_long_page_is_whole():
    page = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert len(main_text(page)) == 50_000 * 10 - 1


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4
    for r in got:
        assert r["n_chars"] == len(r["text"])
    assert extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_given_pages(spark, sf):
    import html
    import re

    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.split("</article>|<footer>", r["html"].split("<article>")[1])[0]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post has-sidebar"><p>Main words</p></article>',
        '<article class="comments-open"><p>Main words</p></article>',
        '<article class="sponsored"><p>Main words</p></article>',
        '<div class="wrapper no-sidebar"><article><p>Main words</p></article></div>',
        '<div id="page" class="with-notice"><article><p>Main words</p></article></div><div class="notice">Else</div>',
        '<div class="widget"><main><p>Main words</p></main></div><div class="widget">Else</div>',
        '<main><div class="sidebar"><div role="article"><p>Main words</p></div></div></main>',
        '<article><div class="widget"><div itemprop="articleBody" class="social">Main words</div></div></article>',
        '<div class="notice"><article>Main words</article></div><section class="comments"><article>I disagree</article></section>',
        '<article>Main words<article class="comment">I disagree</article></article><div class="related"><article>Teaser</article></div>',
        '<div class="wrapper no-sidebar"><p>Main words</p></div><div class="ad-1">Else</div><div id="cookie_notice">Else</div>',
        '<article class="sidebar">Main <b>words',
    ],
)
def test_marks_never_hide_the_article(page):
    assert main_text(page) == "Main words"


@pytest.mark.parametrize("name", ["ad-slot", "advert-box", "user-comments", "comment-list", "comment-section", "google_ad", "cookie-bar", "site-nav", "related-posts", "ad-1"])
def test_compounds_of_marks_are_furniture(name):
    text = "The council met on Monday to settle the plan for the old harbour and its cranes."
    for tag in ("div", "ol", "section"):
        assert main_text(f"<div><p>{text}</p><{tag} class='{name}'><p>{text} Else.</p></{tag}><p>End</p></div>") == f"{text} End"
        assert main_text(f"<main><p>{text}</p><{tag} id='{name}'><p>{text} Else.</p></{tag}><p>End</p></main>") == f"{text} End"
    if {"comment", "comments", "related"} & set(name.split("-")):
        assert main_text(f"<main><p>{text}</p><div class='{name}'><article>I disagree</article></div></main>") == text


@pytest.mark.parametrize("name", ["has-sidebar", "nav-open", "category-advertising", "post-header", "ad-free", "adventure", "tag-cookies topic-social"])
def test_states_and_subjects_are_no_furniture(name):
    assert main_text(f"<div class='{name}'><p>Main words of a page</p></div>") == "Main words of a page"


def test_short_blocks_around_a_surge_stay():
    long = "A sentence of the story that is long enough to be a surge of text by itself."
    page = f"<nav>Menu</nav><div><h2>T</h2><p>word word word word word</p><p>x</p><p>y</p><p>{long}</p><p>z</p><p>{long}</p></div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><p>Short</p>"
    assert main_text(page) == f"T word word word word word x y {long} z {long}"


def test_links_weigh_with_their_neighbours():
    long = "A sentence of the story that is long enough to be a surge of text by itself."
    linked = "<p>See <a href=/r>the full report of the commission on trade</a>.</p>"
    assert main_text(f"<div><p>{long}</p>{linked}<p>{long}</p></div>") == f"{long} See the full report of the commission on trade. {long}"
    menu = "<p><a>Home page</a> | <a>About us</a> | <a>Contact and help</a></p>"
    assert main_text(f"<div>{menu}<p>{long}</p>{menu}<p>* * *</p><p>{long}</p>{menu}</div>") == f"{long} * * * {long}"


@pytest.mark.parametrize(
    "page,n",
    [
        ("<div>" * 100_000 + "</span>" * 100_000 + "words", 5),
        ("<article>" * 50_000 + "words", 5),
        ("<b>" * 50_000 + "<p>w" * 50_000, 2 * 50_000 - 1),
    ],
)
def test_odd_nesting_takes_linear_time(page, n):
    start = time.process_time()
    assert len(main_text(page)) == n
    assert time.process_time() - start < 20
