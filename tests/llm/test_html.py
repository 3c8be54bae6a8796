"""Main text: pages without article elements, boxes, links, hostile and long pages, edge tables."""

from __future__ import annotations

import re
import time
from html import unescape

import pytest

from lexmill.llm.html_text import extract_main_text, main_text

LONG = "Many words of running text stand in this paragraph of the page. " * 8


def lines(*texts):
    return "\n".join(" ".join(t.split()) for t in texts)


def test_links_between_text_are_kept():
    p = f"<p>{LONG}</p>"
    items = "".join(f"<li><a href='{i}'>item {i}</a></li>" for i in range(5))
    assert main_text(f"<body><div>{p}<p><a href=x>only a link</a></p>{p}</div></body>") == lines(LONG, "only a link", LONG)
    for name in ("article", "main", "div", "section"):
        assert main_text(f"<body><{name}>{p}<ul>{items}</ul><p>End.</p></{name}></body>") == lines(LONG, *(f"item {i}" for i in range(5)), "End.")
    assert main_text(f"<body><article>{p}<ul>{items}</ul></article></body>") == lines(LONG, *(f"item {i}" for i in range(5)))
    assert main_text(f"<body><div>{p}<p><a href=x>last link</a></p></div></body>") == lines(LONG, "last link")


def test_several_articles():
    p = f"<p>{LONG}</p>"
    assert main_text(f"<body><article>{p}</article><article>{p}<p>short</p></article></body>") == lines(LONG, LONG, "short")
    assert main_text(f"<main><h1>Title</h1><article>{p}</article></main><footer>{p}</footer>") == lines("Title", LONG)


@pytest.mark.parametrize("name", ["related-work", "post-social-history", "side-effects", "search-methods", "popular-culture", "recommendations", "share-prices", "notice-periods", "header-files"])
def test_names_inside_articles(name):
    page = "<article><p>{0}</p><div {1}='{2}'><p>{0}</p></div></article>"
    for key in ("class", "id"):
        assert main_text(page.format(LONG, key, name)) == lines(LONG, LONG)


@pytest.mark.parametrize("name", ["ad", "ads", "sidebar", "cookie-notice", "notice", "site-nav", "comments", "comment", "newsletter-signup", "post-comments", "breadcrumbs", "footer", "page-footer", "advert left"])
def test_boxes(name):
    for inside in ("<article><p>{0}</p>{1}<p>End.</p></article>", "<div class='content'><p>{0}</p>{1}<p>End.</p></div>"):
        box = f"<div class='{name}'><p>not this {LONG}</p></div>"
        assert main_text("<body>" + inside.format(LONG, box) + "</body>") == lines(LONG, "End.")


def test_link_boxes_inside_articles():
    for name in ("related", "share", "related-posts", "recommended-links"):
        box = f"<div class='{name}'>See: <a href=1>one of the other pages</a> <a href=2>another of the pages</a></div>"
        assert main_text(f"<article><p>{LONG}</p>{box}</article>") == lines(LONG)


def test_fixture_pages_without_article_elements(spark, sf):
    """The same pages with other elements around the article."""
    for row in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect():
        html = row["html"]
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        for start, end in (("<main>", "</main>"), ("<div id='content'>", "</div>"), ("<section><div>", "</div></section>"), ("<div class='post entry'><article>", "</article></div>")):
            assert main_text(html.replace("<article>", start).replace("</article>", end)) == want


@pytest.mark.parametrize("page", ["<a " * 3_300_000, "<p x='" * 1_600_000, "<title>" * 1_400_000, "<" * 10_000_000, "<!--" * 2_500_000, "<title></title" * 700_000, "<p x=\"'" * 1_200_000 + ">", "<div>" * 2_000_000, "<nav>" + "<div>" * 1_000_000 + "</p>" * 1_000_000, "<article><div class=related>x" * 300_000, "<a href=x>" * 1_000_000 + "t", "&amp" * 2_500_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    main_text(page[: len(page) // 8])
    part = time.perf_counter() - began
    main_text(page)
    assert time.perf_counter() - began - part < max(1.0, 30 * part)


def test_long_page_and_odd_markup():
    page = "<html><body><nav><a href=x>m</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article></body></html>"
    assert main_text(page) == lines(*[LONG] * 20_000)
    assert main_text("if a < b and c > d") == "if a < b and c > d"
    assert main_text(f"<p>{LONG}</p><p>cut off <b") == lines(LONG, "cut off <b")
    assert main_text(f"<p title='a>b'>{LONG}</p>") == lines(LONG)
    assert main_text(f"<p title='a>{LONG}</p>") == lines(LONG)
    assert main_text("<p>x</p><!-- never closed " + LONG) == "x"
    assert main_text("<P>&eacute;&#8364;&nbsp;&lt;b&gt;</P>") == "é€ <b>"


def test_edge_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, " \n ", None), (4, "v", f"<article><p>{LONG}</p></article>", "y"), (4, "v", f"<article><p>{LONG}</p></article>", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    want = [(1, "u", "", 0), (2, None, "", 0), (None, None, "", 0), *[(4, "v", lines(LONG), len(lines(LONG)))] * 2]
    assert sorted(map(tuple, extract_main_text(df).collect()), key=str) == sorted(want, key=str)
    assert extract_main_text(df.limit(0)).collect() == []


def test_inline_elements_do_not_cut_a_block():
    assert main_text(f"<article><p>{LONG}</p><p>Text <label>important</label> more</p></article>") == lines(LONG, "Text important more")
    page = f"<article><p>{LONG}</p><p>The value <math><mi>x</mi></math> is <select><option>one</option></select> set <button>now</button>here.</p></article>"
    assert main_text(page) == lines(LONG, "The value x is set here.")
    assert main_text(f"<article><p>{LONG} and <svg><text>no</text></svg>on.</p><form><label>Name</label><input></form></article>") == lines(LONG + "and on.")


@pytest.mark.parametrize("name", ["copyright", "replies", "cookies", "advertising", "modal", "search", "menu", "promotion"])
@pytest.mark.parametrize("around", ["article", "main"])
def test_section_ids_inside_articles_are_anchors(name, around):
    p = "It has three sentences. Each of them says something about it. None is a menu."
    page = f"<{around}><p>{LONG}</p><section id='{name}'><h2>On {name}</h2><p>{p}</p></section></{around}>"
    assert main_text(page) == lines(LONG, f"On {name}", p)


def test_comment_articles_are_left_out():
    said = "<p>I don't think that this is so, and neither does my neighbour who told me.</p>"
    assert main_text(f"<main><p>{LONG}</p><article class='comment'>{said}</article><article class='comment-body' id='comment-7'>{said}</article></main>") == lines(LONG)
    assert main_text(f"<article><p>{LONG}</p></article><section id='comments'><article class='comment'>{said}</article></section>") == lines(LONG)
    assert main_text(f"<main><p>{LONG}</p><section id='comments'>{said}</section></main>") == lines(LONG)
    assert main_text(f"<article class='post sidebar-post'><p>{LONG}</p></article>") == lines(LONG)


@pytest.mark.parametrize("hint", ["class='c-ad'", "id='google_ads_1'", "id='div-gpt-ad-1'", "class='newsletter-cta'"])
def test_names_of_adverts(hint):
    assert main_text(f"<article><p>{LONG}</p><div {hint}><p>Buy this now, it is the best of all.</p></div><p>End.</p></article>") == lines(LONG, "End.")
