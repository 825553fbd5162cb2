"""Site templates: what recurrence alone decides, and what tags and names may not."""

import re

import pytest

from tests.llm.test_ops import page
from zonalis.llm import html_text

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def texts(spark, bodies, host="site.example", **more):
    rows = [(k, f"http://{host}/{k}", page(b, k)) for k, b in enumerate(bodies)]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string"), **more)
    return [r["text"] for r in out.orderBy("page_id").collect()]


def story(k, n=3):
    return [f"Story {LETTERS[k % 26]}{LETTERS[k // 26]} part {LETTERS[i]} goes on and on about it." for i in range(n)]


def blocks(k):
    return "".join(f"<div>{x}</div>" for x in story(k))


def test_templates_alone_give_the_text(spark):
    """Tags and names say nothing: menu, rotating list, notice longer than any story, and foot are plain elements."""
    notice = "All rights reserved by the owners of this site in every country of the world. " * 8
    bodies = [f"<div><span><a href=/>Home</a> <a href=/n>News</a></span></div><div><a href=/{k % 3}>Offer {LETTERS[k % 3]} is here now</a></div><div>{blocks(k)}</div><div>{notice}</div><div>Printed in town</div>" for k in range(24)]
    assert texts(spark, bodies) == ["\n\n".join(story(k)) for k in range(24)]


def test_rare_hosts_keep_what_nothing_marks(spark):
    bodies = [f"<div>Home News</div><div>{blocks(k)}</div>" for k in range(4)]
    assert texts(spark, bodies) == ["\n\n".join(["Home News", *story(k)]) for k in range(4)]


def test_boxes_inside_articles_go(spark):
    box = "<div><h3>Read more</h3><ul><li><a href=/1>One of them</a><li><a href=/2>Two of them</a></ul></div>"
    mail = "<p>Sign up for the daily mail, it costs nothing and comes at six.</p>"
    bodies = [f"<article><h1>Head {LETTERS[k]}</h1>{blocks(k)}{box}{mail}</article>" for k in range(12)]
    assert texts(spark, bodies) == ["\n\n".join([f"Head {LETTERS[k]}", *story(k)]) for k in range(12)]


def test_quotations_on_many_pages_stay(spark):
    quote = "<p>A line that many pages of this host quote word for word.</p>"
    bodies = [f"<article>{blocks(k)}{quote if k % 3 == 0 else ''}</article>" for k in range(45)]
    got = texts(spark, bodies)
    assert got == ["\n\n".join([*story(k), *[re.sub("<.*?>", "", quote)] * (k % 3 == 0)]) for k in range(45)]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_copies_of_an_article_are_no_template(spark, wrap):
    """Thirty copies among ten other pages, with menus and offers that change."""
    bodies = [f"<div><a href=/{k % 7}>Offer {LETTERS[k % 7]}</a></div>" + wrap.format(blocks(0 if k < 30 else k)) for k in range(40)]
    got = texts(spark, bodies)
    assert [g.split("\n\n")[-3:] for g in got] == [story(0 if k < 30 else k) for k in range(40)]


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<main><h1>Head</h1><p>Lead</p><article><p>Story of some length</p></article></main>", "Head\n\nLead\n\nStory of some length"),
        ("<main><p>The story is told here at length</p><section><article><h3>Read next</h3></article></section></main>", "The story is told here at length"),
        ("<p>The story is told here at length, and it goes on</p><article><h3><a href=/n>Next</a></h3></article>", "The story is told here at length, and it goes on"),
        ("<div class=ad-hoc-report><p>The story</p></div>", "The story"),
        ("<div class='notice-of-motion'><p>The motion</p></div>", "The motion"),
        ("<div class=cookie-banner>We use cookies</div><p>tail</p><div id=comments-area><p>Nice</p></div><div class=site-footer-links>x</div>", "tail"),
        ("<div class=widget><article><h1>Head</h1><p>Body</p></article></div>", "Head\n\nBody"),
        ("<div id=comments><article><p>first!</p></article></div><article><p>Told</p></article>", "Told"),
        ("<h1>Head</h1><p>By the desk</p><article><p>Story</p></article><p>Outside</p>", "Head\n\nStory"),
        ("<article><p>One</p></article><article><p>Two</p></article>", "One\n\nTwo"),
        ("<div hidden>secret</div><p style='display: none'>gone</p><form>Mail<p>me</form><p>stays", "stays"),
    ],
)
def test_marks_and_names(body, text):
    assert html_text.Page(page(body)).text() == text


def test_a_very_long_page(spark):
    body = "<article>" + "".join(f"<p>Word {'x' * (i % 50)} {i}</p>" for i in range(60_000)) + "</article>"
    (got,) = texts(spark, [body])
    assert got.count("\n\n") == 59_999
