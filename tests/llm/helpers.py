"""Small corpora and plain ways to the same results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, a long word, other scripts and repeated rows.
ODD = [
    (None, "a row without an id " * 20),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "one two three four"),
    (6, "one two three four five"),
    (7, "x" * 200_000),
    (8, "ÀÉ İı ß 漢字 🙂 a b c"),
    (9, "the same text stands here " * 30),
    (10, "the same text stands here " * 30),
    (10, "the same text stands here " * 30),
    (-5, "THE SAME text stands here " * 30),
    (11, "line\nline\n\nline\n"),
    (12, "<|endoftext|> and <|startoftext|>"),
    ((1 << 63) - 1, "last"),
]


def lower(text: str | None) -> bytes:
    """A-Z lowered, nothing else."""
    return (text or "").encode().lower()


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lower(text))


def frame(spark: SparkSession, rows: list[tuple], key: str = "doc_id", text: str = "text") -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text, T.StringType())])
    return spark.createDataFrame(rows, schema)


def with_clashes(df: DataFrame) -> DataFrame:
    """df with more columns, named like those the operators make for themselves."""
    from pyspark.sql import functions as F

    for name in ("n", "a", "b", "salt", "size", "shard", "range", "component", "node", "words", "low", "high", "tree", "block", "cuts", "rank", "length", "piece", "kept", "seed", "place"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_with_clashes(operator, df: DataFrame) -> None:
    """Other columns, and how rows are dealt, don't matter."""
    assert rows_of(operator(with_clashes(df).repartition(3))) == rows_of(operator(df))
