"""Articles of wiki pages: a page as a tree of elements, and from it the brief and the sections by title."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import SECTION_BLACKLIST

#: Names of the elements that hold an article, and the least characters of what is kept.
CONTENT, BODY, HEADLINE, SHORT = "mw-content-text", "mw-parser-output", "mw-headline", "shortdescription"
HEADINGS, LISTS = ("h2", "h3", "h4"), ("ul", "ol")
BRIEF, PARAGRAPH, ITEM = 40, 30, 20

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an element's start ends, if it is open: paragraphs end where a block begins, items where the next one does.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BORDERS = frozenset("ul ol dl table div section article td th body html".split())
#: Elements whose text isn't text of the page.
_SILENT = frozenset("script style template rt rp".split())
_SPACE, _CITATION = re.compile(r"\s+"), re.compile(r"\[\d+\]")


class Element:
    """An element with its children, which are elements and strings, in order."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str | None]):
        self.name, self.attributes, self.children = name, attributes, []

    def elements(self) -> Iterator[Element]:
        return (c for c in self.children if isinstance(c, Element))

    def descendants(self) -> Iterator[Element]:
        """All elements below this one in the order of their starts, without recursion: pages may be deep."""
        waiting = [self.elements()]
        while waiting:
            found = next(waiting[-1], None)
            if found is None:
                waiting.pop()
                continue
            yield found
            waiting.append(found.elements())

    def find(self, name: str, id_: str | None = None, class_: str | None = None) -> Element | None:
        """The first descendant of a name with an id or a class."""
        for e in self.descendants():
            if e.name == name and (id_ is None or e.attributes.get("id") == id_) and (class_ is None or class_ in (e.attributes.get("class") or "").split()):
                return e
        return None

    def text(self) -> str:
        """The trimmed strings below, joined by spaces; citations are left out and white space is made single."""
        parts, waiting = [], [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                parts.append(child.strip())
            elif child.name not in _SILENT:
                waiting.append(iter(child.children))
        return cleaned(" ".join(p for p in parts if p))


def cleaned(text: str) -> str:
    return _SPACE.sub(" ", _CITATION.sub("", text)).strip()


class _Builder(HTMLParser):
    """Builds the tree; what was left open is ended as browsers do for paragraphs, items and cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def _end_open(self, names: set[str] | frozenset[str]) -> None:
        """End the nearest open element of these names, unless another that keeps things apart lies between."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name in names:
                del self.open[at:]
                return
            if self.open[at].name in _BORDERS:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end_open({"p"})
        if tag in _SIBLINGS:
            self._end_open(_SIBLINGS[tag])
        element = Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def sections_of(page: str, blacklist: tuple[str, ...] = SECTION_BLACKLIST) -> tuple[str, dict[str, str]]:
    """The brief and the sections by title of a page's article; nothing if the page has no article.

    The brief is made of the paragraphs of BRIEF characters or more that lie directly in the article's body before a
    heading does; if there are none, it is the short description. A section holds the paragraphs of PARAGRAPH or more, and
    the lists' own items of ITEM or more, that come between its heading and the next, however deep they lie. Of sections of
    one title the last with a text counts; blacklisted titles and what stands under a blank heading are left out.
    """
    content = tree(page).find("div", id_=CONTENT)
    if content is None:
        return "", {}
    body = content.find("div", class_=BODY) or content
    brief = []
    for e in body.elements():
        if e.name in HEADINGS:
            break
        if e.name == "p" and len(text := e.text()) >= BRIEF:
            brief.append(text)
    sections: dict[str, str] = {}
    title, parts = "", []

    def end() -> None:
        text = cleaned(" ".join(parts))
        if title and text and _SPACE.sub(" ", title.strip().lower()) not in blacklist:
            sections[title] = text
        parts.clear()

    for e in body.descendants():
        if e.name in HEADINGS:
            end()
            title = (e.find("span", class_=HEADLINE) or e).text()
        elif title and e.name == "p":
            if len(text := e.text()) >= PARAGRAPH:
                parts.append(text)
        elif title and e.name in LISTS:
            parts += [text for item in e.elements() if item.name == "li" and len(text := item.text()) >= ITEM]
    end()
    if not brief and (short := body.find("div", class_=SHORT)):
        brief.append(short.text())
    return " ".join(brief), sections


def article_sections(html: Column | str) -> Column:
    """struct<brief, sections map> of pages of HTML, in Arrow batches; a null page has no article."""

    @F.pandas_udf("struct<brief:string,sections:map<string,string>>")
    def parse(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            rows = [sections_of(p or "") for p in batch]
            yield pd.DataFrame({"brief": [b for b, _ in rows], "sections": [s for _, s in rows]})

    return parse(F.col(html) if isinstance(html, str) else html)
