from __future__ import annotations

import re
from html.parser import HTMLParser

import pytest

from graphloom.llm import html
from graphloom.llm.queries import QUERIES

from .helpers import frame, rows_of

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>The  title</h1></header><p>First paragraph, with <b>bold</b> and <a href="x">a link</a> in it; it goes on.
<p>Second&nbsp;one &amp; more &lt;tags&gt; &#233;, unclosed<ul><li>An item<li>Another, item</ul>
<div class="ad">Buy this!</div><aside>Aside</aside><table><tr><td>cell one<td>cell two</table><pre>  code   here </pre>
<section class="comments"><p>A reader's comment, that is long and has, much, punctuation.</p></section>
<form><input value="x"><button>Go</button></form><figure><img src=x><figcaption>Caption</figcaption></figure></article>
<div class="sidebar">Side text</div><footer>&copy; 2020</footer><!-- hidden <p>no</p> --></body></html>"""


def test_article_without_boilerplate():
    assert html.main_text(PAGE).split("\n") == [
        "The title",
        "First paragraph, with bold and a link in it; it goes on.",
        "Second one & more <tags> é, unclosed",
        "An item",
        "Another, item",
        "cell one",
        "cell two",
        "code here",
        "Caption",
    ]


def test_page_without_an_article_element():
    """The tag-path ratios decide."""
    body = "".join(f"<p>Paragraph {i} of the story, which has a good length, commas, and an end. It has a second sentence, too.</p>" for i in range(6))
    page = f"<html><body><div class='menu'><a href=1>One</a></div><ul><li><a href=1>Link one</a></li><li><a href=2>Link two</a></li></ul><div id=story>{body}</div><div><a href=3>Next</a></div></body></html>"
    lines = html.main_text(page).split("\n")
    assert len(lines) == 6 and all(line.startswith("Paragraph") for line in lines)


LONG = "".join(f"<p>Paragraph {i} of the story, which has a good length, some commas, more words than it needs, and an end. It has a second sentence, too.</p>" for i in range(6))
STORY = f"<h1>A headline of few words</h1>{LONG}<ul><li>One item</li><li>Another</li></ul><p>The end</p>"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_headline_and_list_with_and_without_article(tag):
    page = f"<html><body><div><a href=1>Home</a></div><{tag}>{STORY}</{tag}><div>Some place, 2020</div></body></html>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "A headline of few words" and lines[-3:] == ["One item", "Another", "The end"] and len(lines) == 10


def test_headline_and_list_in_the_body():
    lines = html.main_text(f"<html><body><div><a href=1>Home</a></div>{STORY[: -len('<p>The end</p>')]}<div>Some place</div></body></html>").split("\n")
    assert lines[0] == "A headline of few words" and lines[-2:] == ["One item", "Another"] and len(lines) == 9


def test_several_articles_with_content():
    page = f"<html><body><article>{LONG}</article><article><h2>Second</h2>{LONG}</article><article><h3><a href=1>A teaser</a></h3></article></body></html>"
    lines = html.main_text(page).split("\n")
    assert len(lines) == 13 and lines[6] == "Second"


def test_class_words_do_not_decide():
    """Long text with a class or an id that has a common word in it is content, and text-poor boilerplate needs no such class."""
    page = f"""<html><body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>More</a></div><article><div class="social-history">{LONG}</div><p id="discussion">{'It goes on, with much to say. ' * 5}</p></article>
    <div><span>Enter your name</span><input name=q></div><div><a href=4>A link of many words that leads to another page</a></div></body></html>"""
    lines = html.main_text(page).split("\n")
    assert len(lines) == 7 and lines[-1].startswith("It goes on")


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_link_heavy_and_form_heavy_boilerplate(tag):
    links = "".join(f"<li><a href={i}>Story number {i}, told at some length, with commas, and stops.</a></li>" for i in range(30))
    fields = "".join(f"<p>Field {i}<input name=f{i}></p>" for i in range(12))
    page = f"<html><body><ul>{links}</ul><{tag}><h1>Title</h1>{LONG}</{tag}><form>{fields}<button>Send</button></form><ul>{links}</ul><footer>Owner, 2020.</footer></body></html>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "Title" and len(lines) == 7


REMARKS = "".join(f"<div><b>Reader {i}</b><p>I think, as reader number {i}, that this is well said, though long; and much more could be said about it.</p></div>" for i in range(8))


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f'<article>{LONG}<p id="footer">{"A last paragraph that is long, and ends. " * 4}</p></article>', "A last paragraph", None),
        (f'<article>{LONG}<div class="comment-on-method">A remark on the method, by the author: it is sound, and was tried.</div></article>', "A remark on the method", None),
        (f'<article>{LONG}<div class="banner history">It was made in 1820. It hung there for long. Then, it fell. It is kept, now, in a box.</div></article>', "It was made in 1820", None),
        (f'<body><div id="menu-of-the-day"><h1>The menu of the day</h1>{LONG}</div></body>', "The menu of the day", None),
        (f'<body><div>{LONG}</div><section id="responses">{REMARKS}</section></body>', "Paragraph 5", "Reader"),
        (f'<body><div>{LONG}<section id="responses">{REMARKS}</section></div></body>', "Paragraph 5", "Reader"),
        (f'<body><article>{LONG}<ol class="x comment-list">{REMARKS}</ol></article></body>', "Paragraph 5", "Reader"),
        (f'<body><div class="story">{LONG}</div><div class="box"><p>A box of prose, about other things, that stands there.</p></div><div class="box"><p>One more box of prose, about this, and that.</p></div></body>', "Paragraph 5", "box of prose"),
        (f'<body><article>{LONG}<div class="tools">Print Share Save</div></article></body>', "Paragraph 5", "Print"),
        (f'<body><article>{LONG}<div class="ad">Buy this, it is good, and cheap; it is the best that you can have, and more.</div><p>The end</p></article></body>', "The end", "Buy"),
        (f'<body><nav><p>Some text in a menu, with a comma.</p></nav><main>{LONG}<table><tr><td>cell</td></tr></table></main><aside><p>Something beside it, said in a sentence, or two.</p></aside></body>', "cell", "beside"),
        # Other templates: nested boxes of one class, and a page of divisions alone.
        (f'<body><div class="wrap"><div class="col">{LONG}</div><div class="col"><a href=1>One</a> <a href=2>Two</a></div></div></body>', "Paragraph 0", "One"),
        ("<body>" + "".join(f"<div>Line {i} of a story without paragraphs, which is long, and has its commas, and stops. It goes on so.</div>" for i in range(9)) + "</body>", "Line 8", None),
    ],
)
def test_content_stays_and_boilerplate_goes(page, kept, gone):
    text = html.main_text(f"<html>{page}</html>")
    assert kept in text and (gone is None or gone not in text)
    assert text.count("Paragraph") in (0, 6)


def test_paths_have_no_numbers():
    """Blocks of like elements are of one path, wherever they stand."""
    found = html.blocks("<body><div class='a b'><p>x</div><div class='a b'><p>y<p>z</div><div><p>w</div></body>")
    assert [b.path for b in found] == ["/body/div.a.b/p"] * 3 + ["/body/div/p"]


def test_the_ratios_decide(monkeypatch):
    """With equal weights, pages whose boilerplate has no hint come out whole."""
    links = "".join(f"<p><a href={i}>Story number {i}</a></p>" for i in range(30))
    page = f"<html><body><div>{links}</div><div>{LONG}</div></body></html>"
    assert len(html.main_text(page).split("\n")) == 6
    monkeypatch.setattr(html, "weights", lambda found: __import__("numpy").ones(len(found)))
    assert len(html.main_text(page).split("\n")) > 6


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!--", "<article>", "</p></article>", "<script>x", "<article></article>", "&", "&#xFFFFFFFF;", "<a href='", "<p class=\"x>y</p>", "\0", "<" * 5000, "<div>" * 3000 + "deep" + "</div>" * 3000])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


class Plain(HTMLParser):
    """The blocks inside article, by the standard library's parser; this template only has h1, p, b and br there."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_all_pages(spark, medium):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    got = QUERIES["op4_main_text"](spark, medium).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = Plain()
        parser.feed(pages[r["page_id"]]["html"])
        want = "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in parser.blocks) if x)
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_odd_rows(spark):
    rows = [(None, PAGE), (1, None), (2, ""), (3, "<p>" + "long " * 100_000), (4, PAGE), (4, PAGE), (5, "only text")]
    pages = spark.createDataFrame([(d, None if d == 4 else "u", t) for d, t in rows], "page_id long, url string, html string")
    got = rows_of(html.extract(pages.selectExpr("*", "'clash' AS text", "1 AS n_chars")))
    assert got == sorted(((d, None if d == 4 else "u", x := html.main_text(t or ""), len(x)) for d, t in rows), key=repr)
    assert html.extract(pages.limit(0)).count() == 0
    assert frame(spark, [(1, "x")]).count() == 1
