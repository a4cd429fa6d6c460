"""Texts by item: where each item's text lies, which chunks are read, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_chunks(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts (chunk, …) of the named chunks (chunk) alone; none being left is an error."""
    kept = texts.join(chunks.select("chunk"), "chunk", "left_semi")
    if kept.isEmpty():
        raise ValueError("none of the chunks has texts")
    return kept


def text_index(texts: DataFrame) -> DataFrame:
    """(wid, chunk, position) of each item's text: of several the last by chunk and position. Empty items have none."""
    last = texts.filter("wid != ''").groupBy("wid").agg(F.max(F.struct("chunk", "position")).alias("at"))
    return last.select("wid", "at.chunk", "at.position")


def looked_up(wanted: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """wanted (wid, …) with each item's text, empty if it has none."""
    found = texts.join(text_index(texts), ["wid", "chunk", "position"]).select("wid", text)
    return wanted.join(found, "wid", "left").withColumn(text, F.coalesce(text, F.lit("")))
