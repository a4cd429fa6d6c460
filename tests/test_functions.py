from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import articles as A
from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.functions.hashing import draw, order_hash


def one(spark, column):
    return spark.range(1).select(column).first()[0]


LABELS = [(["ART"], True, True), ([" ART"], True, False), (["art"], False, True), ([], False, False), (None, False, False), (["PERSON", "ART "], True, False)]


@pytest.mark.parametrize("labels, exact, any_case", LABELS)
def test_labels(spark, labels, exact, any_case):
    df = spark.createDataFrame([(labels,)], "labels array<string>")
    assert tuple(df.select(P.has_label("labels", "ART"), P.has_label_any_case("labels", "ART")).first()) == (exact, any_case)


IMAGES = [(["http://a"], True, True), (["HTTPS://b/y.png", "ftp://c"], True, False), (["", "https://x"], True, True), ([" "], False, False), ([], False, False), (None, False, False)]


@pytest.mark.parametrize("images, some, every", IMAGES)
def test_images(spark, images, some, every):
    df = spark.createDataFrame([(images,)], "images array<string>")
    assert tuple(df.select(P.any_image_url("images"), P.all_image_urls("images")).first()) == (some, every)


RECORDS = [("ok", None, None, True), ("no_sitelink", "u", " ", False), ("no_sitelink", "", "b", True), ("error", "u", "", True), ("error", "", None, False), (None, "", "b", True), (None, None, None, False)]


@pytest.mark.parametrize("status, url, brief, terminal", RECORDS)
def test_terminal(spark, status, url, brief, terminal):
    df = spark.createDataFrame([(status, url, brief)], "status string, url string, brief string")
    assert df.select(P.is_terminal("status", "url", "brief")).first()[0] is terminal


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.lit(" a  b[12]\n c [x] "))) == "a b c [x]"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) is None


TIMES = [("+1503-07-09T00:00:00Z", 11, "1503-07-09"), ("-0044-03-15T00:00:00Z", 11, "-0044-03-15"), ("+1503-07-00T", 10, "1503-07"), ("+1503-00-00T", 9, "1503"), ("-0300-00-00T", 9, "-300"), ("+1500-00-00T", 8, "circa 1500s"), ("+1500-00-00T", 7, "circa AD 1500"), ("-0300-00-00T", 7, "circa 300 BC"), ("+0090-00-00T", 6, "90"), ("soon", 11, "soon")]


@pytest.mark.parametrize("time, precision, text", TIMES)
def test_times(spark, time, precision, text):
    assert one(spark, T.format_time(F.lit(time), F.lit(precision))) == text


def test_fallback_brief(spark):
    full = T.fallback_brief(*map(F.lit, ("Q1", "A vase..", "old thing", "1500", "1900", "Museum", "N7", "France", 1.5, -2.25)))
    assert one(spark, full) == "A vase. old thing. Created 1500. Discovered 1900. Held by Museum, inventory no. N7. Country: France. Coordinates: 1.500000, -2.250000."
    none = [F.lit(None).cast("string")] * 9
    assert one(spark, T.fallback_brief(F.lit("Q1"), *none)) == "Q1."


def test_names(spark):
    assert one(spark, T.slug(F.lit(" org\\model v1/ "))) == "org__model_v1" and one(spark, T.slug(F.lit("  "))) == "default"
    assert one(spark, T.wid_of_stem(F.lit("Q5_3"))) == "Q5" and one(spark, T.wid_of_stem(F.lit("x_Q5"))) is None
    assert one(spark, T.chunk_number(F.lit("chunk_000012_nid_1_2"))) == 12 and one(spark, T.chunk_number(F.lit("other"))) == 10**9
    assert one(spark, T.chunk_name(F.lit(3), F.lit(10).cast("long"), F.lit(99).cast("long"))) == "chunk_000003_nid_0000000010_0000000099"
    assert one(spark, T.image_file(F.lit(""), F.lit(7), F.lit("http://a/b.PNG"))) == "node_7.png" and one(spark, T.image_file(F.lit("Q1"), F.lit(7), F.lit("a.tif"))) is None
    assert one(spark, T.duration(F.lit(3725))) == "1:02:05"


def article(inner: str) -> str:
    return f'<html><p>Text before the article, long enough to count as a paragraph.</p><div id="mw-content-text"><div class="x mw-parser-output">{inner}</div></div><p>Text after the article, which is long enough, too.</p></html>'


LONG, OTHER = "A paragraph of text that is surely longer than forty characters", "Another paragraph, which has over thirty"


@pytest.mark.parametrize(
    ("inner", "brief", "sections"),
    [
        (f"<p>Too short.</p><p>{LONG}[3].</p>", f"{LONG}.", {}),
        # Only paragraphs directly in the body go into the brief; a heading further down does not end it.
        (f"<div><p>{LONG} in a box.</p><h2>Inner</h2></div><p>{LONG}</p>", LONG, {"Inner": LONG}),
        (f"<p>{LONG}</p><h1>Not a heading</h1><p>{LONG} too</p><h4>Stop</h4><p>{LONG} later</p>", f"{LONG} {LONG} too", {"Stop": f"{LONG} later"}),
        # The span of the headline is the title, without the links beside it.
        (f'<h2><span class="a mw-headline">His <i>tory</i>[1]</span><span>[edit]</span></h2><p>{OTHER}</p><p>short</p>', "", {"His tory": OTHER}),
        # Of sections of one title the last with a text counts.
        (f"<h2>A</h2><p>{OTHER} 1</p><h2>B</h2><p>{OTHER} 2</p><h3>A</h3><p>{OTHER} 3</p><h3>A</h3><p>no</p>", "", {"A": f"{OTHER} 3", "B": f"{OTHER} 2"}),
        # A list gives its own items, which hold what lies in them; the list within is a list of its own.
        ("<h2>L</h2><ul><li>An item of over twenty characters<li>no<li>With a list: <ol><li>an inner item of over twenty</ol></ul>", "", {"L": "An item of over twenty characters With a list: an inner item of over twenty an inner item of over twenty"}),
        # Paragraphs at any depth go into sections; blacklisted titles don't, nor what stands under a blank one.
        (f"<h2>T</h2><table><tr><td><p>{OTHER} deep</p></table><h2> SEE  also </h2><p>{OTHER}</p><h2> </h2><p>{OTHER}</p>", "", {"T": f"{OTHER} deep"}),
        ('<div class="noprint shortdescription">A short  description[2]</div><p>short</p>', "A short description", {}),
        (f"<p>{LONG}<script>var p = '<p>';</script><style>p {{}}</style> &amp; more<p>{LONG} again<div>x</div>", f"{LONG} & more {LONG} again", {}),
        ("", "", {}),
    ],
)
def test_articles(inner, brief, sections):
    assert A.sections_of(article(inner)) == (brief, sections)


def test_pages_without_an_article(spark):
    assert A.sections_of(f"<p>{LONG}</p>") == ("", {}) and A.sections_of("") == ("", {})
    # Without a parser's output the content is the body; a span of that name is none.
    assert A.sections_of(f'<span id="mw-content-text"></span><div id="mw-content-text"><p>{LONG}</p>') == (LONG, {})
    deep = "<div>" * 20_000
    assert A.sections_of(article(f"<h2>D</h2>{deep}<p>{OTHER}</p>"))[1]["D"].startswith(OTHER)
    row = spark.createDataFrame([(article(f"<p>{LONG}</p>"),), (None,)], "html string").select(A.article_sections("html").alias("x")).collect()
    assert row[0].x.brief == LONG and row[1].x.brief == "" and row[1].x.sections == {}


def test_assembled(spark):
    sections = F.create_map(F.lit("Title"), F.lit(" body "), F.lit("Blank"), F.lit("  "))
    assert one(spark, T.assemble_text(F.lit(" brief"), sections)) == "brief\nbody"
    assert one(spark, T.assemble_text(F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"))) == ""


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, V.transe(v(1, 2), v(0, 1), v(1, 3))) == 0.0
    assert one(spark, V.transe(v(0, 0), v(0, 0), v(3, 4))) == -5.0
    # (1+2i)(3+4i) times the conjugate of (5+6i).
    assert one(spark, V.complex_(v(1, 2), v(3, 4), v(5, 6))) == ((1 + 2j) * (3 + 4j) * (5 - 6j)).real
    assert one(spark, V.dense(v(1, -1), [[1.0, 2.0], [-3.0, 0.0]], [0.5, 0.0], True)) == [0.0, 0.0]
    assert one(spark, V.fused(v(1), F.lit(None).cast("array<double>"), [2.0], [[1.0, 1.0, 9.0]], [0.0])) == [3.0]
    assert one(spark, V.hashed_bag(F.lit(None).cast("string"), 4)) == [0.0] * 4
    assert one(spark, V.logit_loss(F.lit(1000.0), F.lit(1.0))) == 0.0


def test_hashes(spark):
    rows = spark.range(1000).select(order_hash(1, "id").alias("h"), order_hash(2, "id").alias("g"), draw(10, 1, "id").alias("d")).collect()
    assert len({r.h for r in rows}) == 1000 and all(r.h != r.g for r in rows)
    assert min(sum(r.d == k for r in rows) for k in range(10)) > 60
