"""Main text of web pages by tag-path ratios.

Every block of text, boilerplate included, belongs to the path of tags and classes from the root to it. Per path, the
length of its text without links and its punctuation are set in ratio to the number of blocks on the path, fused, and
smoothed along the page with the ratios of neighbouring blocks. Tags, roles and class names that are usual for boilerplate or for
articles only scale a weight; blocks whose weight reaches the threshold are content. What readers have said
can't be told from a story by its ratios, so containers named for it are left out as such.

The innermost element that holds most of all content, or one around it that adds content of the same paths, headings or lists, is the
article. Of its blocks the content stays, and what has a place of its own in a text (headings, paragraphs, list items,
cells, captions, quotations) unless it is links alone or its hint weighs it down; other short lines go. Where that
element is the whole body, blocks before the first and after the last content are left out but for headings and lists beside it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, text_bytes

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
# Elements whose text is no text of the page.
_SILENT = frozenset("head script style noscript template iframe object embed svg canvas select textarea datalist audio video map title".split())
# Hints, which scale weights: elements, roles and class words that are usual for boilerplate.
_FAINT_TAGS = frozenset("nav header footer aside form dialog menu button label search".split())
_FAINT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note advertisement".split())
# Whole names in a class or an id; those of adverts are used for nothing else, the others for content, too.
_ADVERTS = frozenset("ad ads advert adverts advertisement sponsored promo cookie-notice cookie-banner".split())
_FAINT_WORDS = frozenset("banner cookie cookies consent notice newsletter subscribe sidebar menu nav navbar breadcrumb breadcrumbs pagination footer share sharing login signup".split())
_REMARKS = frozenset("comments comment-list commentlist comment-section comments-area user-comments reader-comments responses replies disqus_thread".split())
_CONTAINERS = frozenset("section div aside ol ul article main details footer".split())
# Elements whose text has a place of its own, however short it is.
_PLACED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote legend summary address".split())
# An open paragraph ends where one of these begins.
_ENDS_P = _BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SAME_WITHIN = frozenset("ul ol menu dl table select div article section body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

THRESHOLD = 0.5
SMOOTHING = 1
#: What a tag or role of boilerplate, an advert's name, another name, and standing in an article or main element make of a weight.
FAINT_TAG, ADVERT, FAINT_WORD, LIFTED = 0.25, 0.1, 0.7, 1.5
#: The share of all content that the chosen element must hold.
MOST = 0.7


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _hint(tag: str, attributes: dict[str, str], in_article: bool) -> float:
    """What an element's tag, role and names make of the weight of its blocks. An article's own header holds its title."""
    names = {w for a in ("class", "id") for w in attributes.get(a, "").lower().split()}
    if names & _ADVERTS:
        return ADVERT
    if tag in _FAINT_TAGS and not (tag == "header" and in_article) or attributes.get("role", "").lower() in _FAINT_ROLES:
        return FAINT_TAG
    return FAINT_WORD if names & _FAINT_WORDS else 1.0


def _remarks(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element holds what readers have said."""
    return tag in _CONTAINERS and any(w in _REMARKS for a in ("class", "id") for w in attributes.get(a, "").lower().split())


class _Block:
    __slots__ = ("elements", "hint", "lifted", "linked", "path", "tag", "text")

    def __init__(self, path: str, tag: str, elements: tuple[int, ...], hint: float, lifted: bool):
        self.path, self.tag, self.elements, self.hint, self.lifted, self.text, self.linked = path, tag, elements, hint, lifted, [], 0


class _Element:
    __slots__ = ("hint", "lifted", "name", "number", "silent", "tag")

    def __init__(self, tag: str, name: str, number: int, silent: bool, hint: float, lifted: bool):
        self.tag, self.name, self.number, self.silent, self.hint, self.lifted = tag, name, number, silent, hint, lifted


def blocks(page: str) -> list[_Block]:
    """The page's blocks of text in order."""
    out: list[_Block] = []
    stack = [_Element("", "", 0, False, 1.0, False)]
    open_block, numbered = None, 0
    at, size = 0, len(page)

    def say(text: str) -> None:
        nonlocal open_block
        top = stack[-1]
        if top.silent or not text:
            return
        if open_block is None:
            if not text.strip():
                return
            around = [e for e in stack if e.tag in _BLOCKS or not e.tag]
            open_block = _Block("/".join(e.name for e in around), around[-1].tag, tuple(e.number for e in around), top.hint, top.lifted)
            out.append(open_block)
        open_block.text.append(text)
        if any(e.tag == "a" for e in stack):
            open_block.linked += len(text.strip())

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            say(entities.unescape(page[at:]))
            break
        say(entities.unescape(page[at : found.start()]))
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag in _BLOCKS:
            open_block = None
        if found[1]:
            close(tag)
            continue
        if tag in _ENDS_P and any(e.tag == "p" for e in stack):
            close("p")  # inline elements left open in it end with it
        if tag in _SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SAME[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SAME_WITHIN:
                    break
        if tag == "br":
            say(" ")
        if tag in _VOID:
            continue
        attributes = _attributes(found[3] or "")
        if tag in _RAW:
            # Everything up to its own end tag is not markup.
            at = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at).end()
            continue
        top = stack[-1]
        lifted = top.lifted or tag in ("article", "main") or attributes.get("role") in ("main", "article")
        silent = top.silent or tag in _SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _remarks(tag, attributes)
        numbered += 1
        name = ".".join([tag, *attributes.get("class", "").split()])
        stack.append(_Element(tag, name, numbered, silent, min(top.hint, _hint(tag, attributes, lifted)), lifted))
    return out


def weights(found: list[_Block]) -> np.ndarray:
    """Each block's weight: its path's ratios fused, smoothed along the page, and scaled by hints."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([paths[b.path] for b in found])
    joined = ["".join(b.text) for b in found]
    length = np.array([max(0, len(t.strip()) - b.linked) for t, b in zip(joined, found, strict=True)], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in joined], float)
    nodes = np.bincount(of)
    ratio = np.sqrt((np.bincount(of, length) / nodes)[of] * (1 + (np.bincount(of, marks) / nodes)[of]))
    kernel = np.array([1.0, 2.0, 1.0][: 2 * SMOOTHING + 1])
    smooth = np.convolve(np.pad(ratio, SMOOTHING, mode="edge"), kernel / kernel.sum(), "valid")
    # Links alone weigh nothing, though their path may hold text.
    return smooth * np.array([b.hint * (LIFTED if b.lifted else 1.0) * (not _links_alone(b)) for b in found])


def _links_alone(block: _Block) -> bool:
    return block.linked >= len("".join(block.text).strip())


def _beside(block: _Block) -> bool:
    """A heading or a part of a list, without a boilerplate hint."""
    tags = {re.split(r"[.]", name)[0] for name in block.path.split("/")}
    return block.hint == 1 and (block.tag in ("h1", "h2", "h3", "h4", "h5", "h6") or not {"li", "dt", "dd"}.isdisjoint(tags))


def main_text(page: str) -> str:
    """The article's blocks, each with its white space as single spaces, joined by line feeds. Empty if there are none."""
    found = blocks(page.replace("\0", ""))
    if not found:
        return ""
    weight = weights(found)
    content = (weight >= THRESHOLD * weight.mean()) & (weight > 0)
    at = np.flatnonzero(content)
    if not len(at):
        return ""
    mass: dict[int, float] = {}
    for i in at:
        for k in found[i].elements:
            mass[k] = mass.get(k, 0.0) + weight[i]
    most = MOST * mass[0]
    chosen = max(k for k, m in mass.items() if m >= most)  # numbered in page order: the last is the innermost
    # Outwards, as long as what an element adds is mostly content, outside of articles of the same paths, or headings and lists.
    chain = next(b.elements for b in found if chosen in b.elements)
    inner = {i for i, b in enumerate(found) if chosen in b.elements}
    paths = {found[i].path for i in at if i in inner}
    for k in chain[: chain.index(chosen)][::-1]:
        added = [i for i, b in enumerate(found) if k in b.elements and i not in inner]
        if added and 2 * sum(bool(content[i]) and (found[i].lifted or found[i].path in paths) or _beside(found[i]) and not _links_alone(found[i]) for i in added) <= len(added):
            break
        if added:
            chosen = k
            inner.update(added)
    within = [i for i, b in enumerate(found) if chosen in b.elements and (content[i] or b.tag in _PLACED and b.hint > FAINT_TAG and not _links_alone(b))]
    outer = found[within[0]]
    if outer.path.split("/")[outer.elements.index(chosen)].partition(".")[0] in ("", "html", "body"):
        # No element sets the content apart: from its first block to its last, and the headings and lists beside it.
        low, high = (within.index(i) for i in (at[0], at[-1]))  # content of the whole page is within the body
        while low > 0 and _beside(found[within[low - 1]]):
            low -= 1
        while high + 1 < len(within) and _beside(found[within[high + 1]]):
            high += 1
        within = within[low : high + 1]
    lines = (_SPACE.sub(" ", "".join(found[i].text)).strip() for i in within)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). A null or empty html, or one without content, gives
    an empty text. Repeated rows get a row each, extra columns are ignored, an empty table gives no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(raw.decode("utf-8", "replace")) for raw in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = narrow(pages, page_id="page_id", url="url", html="html").select("page_id", "url", text_bytes("html").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
