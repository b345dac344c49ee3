"""Main text of pages with all kinds of surroundings."""

import time

import pytest

from sensorloom.llm import html
from tests.llm.conftest import SF, rows_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and this is a rather long sentence about them that runs on and on.</div>
{body}
<aside id="sidebar"><p>Read also this other and quite long teaser text that is no part of the article.</p></aside>
<form><label>Name</label><input name="x"><button>Send</button></form>
<section id="comments"><h2>Comments</h2><p>A reader wrote something long about the article, which must not be part of it.</p></section>
<footer>&copy; 2020 somebody</footer></body></html>"""
BODY = "<h1>A title &amp; more</h1><p>First <b>par</b>agraph\n of   the text, which is of some length &mdash; with a link <a href='x'>here</a>.<p>Short.<div class='ad'>Buy!</div><ul><li>One<li>Two</ul><p>Last one, again with more words than the others had before it."
WANT = "A title & more First paragraph of the text, which is of some length — with a link here. Short. One Two Last one, again with more words than the others had before it."


def test_article_and_unmarked_containers():
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div id='c'><div class='text'>{}</div></div>"):
        assert html.main_text(PAGE.format(body=wrap.format(BODY))) == WANT, wrap


def test_article_in_sibling_parts():
    first, second = "A long paragraph of the article with many words. " * 6, "The other part of it, of as many words or so. " * 4
    for tag in ("div", "section"):
        body = f"<{tag}><p>{first}</p></{tag}><{tag}><p>{second}</p></{tag}>"
        assert html.main_text(PAGE.format(body=body)) == f"{first}{second}".strip(), tag


def test_head_without_an_end():
    for rest in ("<body><p>The text.</p></body>", "<p>The text.</p>", "<div class='x'><p>The text.</p></div>", "The text."):
        assert html.main_text(f"<html><head><meta charset=utf-8><title>T</title><style>p{{}}</style>{rest}</html>") == "The text.", rest


def test_names_of_wrappers():
    for name in ("class='has-sidebar'", "id='page-with-nav'", "class='post comment-open'", "class='widget'"):
        for inner in ("<div>{}</div>", "<p>{}</p>", "<article><p>{}</p></article>"):
            page = PAGE.format(body=f"<div {name}>{inner.format('The article has many words and goes on. ' * 20)}</div>")
            assert html.main_text(page) == ("The article has many words and goes on. " * 20).strip(), (name, inner)


def test_long_comments_stay_out():
    comments = "<div id='comments'><p>" + "A reader wrote this, at more length than the article has. " * 30 + "</p></div>"
    for body in (f"<div><p>{WANT}</p></div>{comments}", f"<article><p>{WANT}</p></article>{comments.replace('comments', 'all-comments')}"):
        assert html.main_text(PAGE.format(body=body)) == WANT


def test_broken_and_plain_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><!-- x -->") == ""
    assert html.main_text("just   text &lt;b&gt;") == "just text <b>"
    assert html.main_text("<article><p>Open <b>end") == "Open end"
    assert html.main_text("<div><p>x</p></div></div></article>tail") in ("x tail", "x")


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for page, out in zip(sorted(rows_of(pages), key=lambda r: r["page_id"]), sorted(rows_of(html.extract(pages)), key=lambda r: r["page_id"]), strict=True):
        article = page["html"].split("<article>")[1].split("</article>")[0]
        assert out["text"].split() == html.main_text(article).split()
        assert out["n_chars"] == len(out["text"])


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "<p>x</p>", "b"), (None, "<p>x</p>", "b")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert out.columns == ["page_id", "text", "n_chars"]
    assert sorted(r["text"] for r in rows_of(out)) == ["", "", "x", "x"]
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("page", [
    "<div>" * 300_000 + "<p>Deep text stands here.</p>",
    "<b>" * 100_000 + "<p>x</p>" * 100_000 + "</i>" * 100_000,
    "<body><p>Text.</p>" + "<div class=has-sidebar>y" * 100_000,
    "<ul>" + "<li><span>a" * 100_000,
])
def test_deep_and_broad_pages_take_linear_time(page):
    begin = time.process_time()
    assert html.main_text(page)
    assert time.process_time() - begin < 30
