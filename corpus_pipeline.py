"""Documents made ready for training, in five stages; each works on all that the stage before it has kept.

Every stage but the last returns the columns that it was given, extra ones with them. A row without a doc_id is judged by
its text alone: it is nobody's copy, and is never cut. Rows that repeat a doc_id and its text stay or go together. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chaining, decontaminate, neardup, packing, quality
from graphloom.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null, empty and very short texts are rejected; so is each of several equal
    rows."""
    return quality.passed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, with all rows that repeat it. Null and
    empty texts are no duplicates of one another, and a row without a doc_id stays."""
    return neardup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a lesser doc_id holds, too, are cut from the later one. What has no words left goes; null
    and empty texts stay as they are, and so does a row without a doc_id."""
    return chaining.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go, with all rows of their doc_id. Null and empty texts hold none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its sequence and its place there. A null or empty text is a piece of one token,
    repeated rows are pieces of their own, and pieces of one length are placed by doc_id."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the fitted classifier of the first stage nor the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
