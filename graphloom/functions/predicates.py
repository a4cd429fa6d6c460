"""Predicates on labels, image addresses, relation names and fetch records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = "^https?://"
# Section titles that are not text.
SECTION_BLACKLIST = ("references", "notes", "external links", "see also", "further reading", "bibliography", "sources", "citations")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_label(labels: Column | str, label: str) -> Column:
    """The label stands in labels, but for white space around it. Null labels have none."""
    return F.coalesce(F.exists(_column(labels), lambda x: F.trim(x) == label), F.lit(False))


def has_label_any_case(labels: Column | str, label: str) -> Column:
    """The label stands in labels, whatever its case; white space counts."""
    return F.coalesce(F.exists(_column(labels), lambda x: F.upper(x) == label.upper()), F.lit(False))


def any_image_url(images: Column | str) -> Column:
    """At least one item is an http(s) address."""
    return F.coalesce(F.exists(_column(images), lambda x: F.lower(F.trim(x)).rlike(_URL)), F.lit(False))


def all_image_urls(images: Column | str) -> Column:
    """There are items that aren't blank, and all of them are http(s) addresses."""
    worded = F.filter(_column(images), lambda x: F.trim(x) != "")
    return F.coalesce((F.size(worded) > 0) & F.forall(worded, lambda x: F.lower(F.trim(x)).rlike(_URL)), F.lit(False))


def is_wid(wid: Column | str) -> Column:
    return F.coalesce(_column(wid).startswith("Q"), F.lit(False))


def is_terminal(status: Column | str, url: Column | str, brief: Column | str) -> Column:
    """A fetch record that needs no further try: ok; no page but a text; or, of any other status, an address or a text."""
    text = F.trim(F.coalesce(_column(brief), F.lit(""))) != ""
    address = F.coalesce(_column(url), F.lit("")) != ""
    status = F.coalesce(_column(status), F.lit(""))
    return F.when(status == "ok", True).when(status == "no_sitelink", text).otherwise(address | text)


def is_bad_section(title: Column | str, blacklist: tuple[str, ...] = SECTION_BLACKLIST) -> Column:
    return F.regexp_replace(F.lower(F.trim(_column(title))), r"(?U)\s+", " ").isin(*blacklist)
