"""Text functions: cleaning, assembling, dates and names. Formats of sentences, dates and names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text: Column | str) -> Column:
    """Without [n] citations, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_column(text), r"\[\d+\]", ""), r"(?U)\s+", " "))


def assemble_text(brief: Column | str, sections: Column | str) -> Column:
    """The brief and the sections' values, trimmed, blank ones left out, joined by line feeds. Titles are not kept."""
    parts = F.concat(F.array(_column(brief)), F.coalesce(F.map_values(_column(sections)), F.array().cast("array<string>")))
    trimmed = F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def format_time(time: Column | str, precision: Column | str) -> Column:
    """A +YYYY-MM-DDT… time as text: day (precision 11), month (10), year (9), decade (8), century (7). Other text stays."""
    time, precision = _column(time), _column(precision)
    pattern = r"^([+-])(\d{4})-(\d{2})-(\d{2})T"
    part = lambda k: F.regexp_extract(time, pattern, k)
    before = (part(1) == "-") & (part(2) != "0000")
    minus = F.when(before, "-").otherwise("")
    year = F.concat(minus, part(2).cast("int").cast("string"))
    return (
        F.when(~time.rlike(pattern), time)
        .when(precision >= 11, F.concat(minus, part(2), F.lit("-"), part(3), F.lit("-"), part(4)))
        .when(precision == 10, F.concat(minus, part(2), F.lit("-"), part(3)))
        .when(precision == 8, F.concat(F.lit("circa "), year, F.lit("s")))
        .when((precision == 7) & before, F.concat(F.lit("circa "), part(2).cast("int").cast("string"), F.lit(" BC")))
        .when(precision == 7, F.concat(F.lit("circa AD "), year))
        .otherwise(year)
    )


def fallback_brief(qid, label, description, created, discovered, collection, inventory, country, latitude, longitude) -> Column:
    """A sentence or two from what is known of an item; every part but the label may be null."""
    qid, label, description, created, discovered, collection, inventory, country, latitude, longitude = map(_column, (qid, label, description, created, discovered, collection, inventory, country, latitude, longitude))
    full = lambda x: F.concat(F.regexp_replace(F.trim(x), r"\.+$", ""), F.lit("."))
    said = lambda before, x: F.when(x.isNotNull(), F.concat(F.lit(before), x, F.lit(".")))
    held = F.when(collection.isNotNull() & inventory.isNotNull(), F.concat(F.lit("Held by "), collection, F.lit(", inventory no. "), inventory, F.lit(".")))
    place = F.when(latitude.isNotNull() & longitude.isNotNull(), F.format_string("Coordinates: %.6f, %.6f.", latitude.cast("double"), longitude.cast("double")))
    described = F.when(F.trim(description) != "", full(description))
    return F.concat_ws(" ", full(F.coalesce(label, qid)), described, said("Created ", created), said("Discovered ", discovered), F.coalesce(held, said("Inventory no. ", inventory)), said("Country: ", country), place)


def image_file(wid: Column | str, node_id: Column | str, url: Column | str) -> Column:
    """The file name an image address is stored under; null for none and for TIF."""
    lower = F.lower(_column(url))
    kind = F.coalesce(*[F.when(lower.endswith(e), e) for e in (".png", ".jpeg", ".gif", ".svg")], F.lit(".jpg"))
    name = F.coalesce(F.nullif(_column(wid), F.lit("")), F.concat(F.lit("node_"), _column(node_id).cast("string")))
    return F.when((lower != "") & ~lower.rlike(r"\.tiff?$"), F.concat(name, kind))


def title_url(title: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(_column(title), F.lit(" "), F.lit("_")))


def wid_of_stem(stem: Column | str) -> Column:
    """The item of an image file's stem: what stands before its first underscore; null if it isn't a Q id."""
    return F.when(_column(stem).startswith("Q"), F.substring_index(_column(stem), "_", 1))


def slug(name: Column | str) -> Column:
    """A model's name as a folder's name."""
    path = F.regexp_replace(F.replace(F.trim(_column(name)), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    plain = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), "[^A-Za-z0-9._-]", "_")
    return F.when(plain == "", "default").otherwise(plain)


def chunk_number(name: Column | str, none: int = 1_000_000_000) -> Column:
    """The number in a chunk folder's name; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(_column(name), r"^chunk_(\d+)_", 1), F.lit("")).try_cast("long"), F.lit(none))


def chunk_name(number: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.format_string("chunk_%06d_nid_%010d_%010d", _column(number), _column(low), _column(high))


def preferred(statements: Column | str) -> Column:
    """The first preferred statement of an array of structs with a rank, else the first; null if there is none."""
    return F.coalesce(F.try_element_at(F.filter(_column(statements), lambda x: x["rank"] == "preferred"), F.lit(1)), F.try_element_at(_column(statements), F.lit(1)))


def duration(seconds: Column | str) -> Column:
    """h:mm:ss"""
    s = F.floor(_column(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
