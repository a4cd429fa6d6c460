"""Caches of vectors and samples that are kept between runs: named by their settings, guarded, and known to be whole."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_folder(root: str, settings: dict, sample_chunks: int | None = None) -> str:
    """The folder of a cache: settings are part of its name, and a run over the first chunks alone has one of its own."""
    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
    return f"{root}/sample-{sample_chunks}/{key}" if sample_chunks else f"{root}/{key}"


def write_cache(rows: DataFrame, folder: str, settings: dict, keys: str = "node") -> None:
    """Write a cache by key ranges, and then what it was made with; a stopped run leaves no settings and is not read."""
    rows.repartitionByRange(keys).sortWithinPartitions(keys).write.mode("overwrite").parquet(f"{folder}/rows")
    said = rows.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string")
    said.coalesce(1).write.mode("overwrite").text(f"{folder}/settings")


def read_cache(spark: SparkSession, folder: str, settings: dict) -> DataFrame:
    """The rows of a cache; one made with other settings is an error."""
    said = spark.read.text(f"{folder}/settings").first()
    if said is None or json.loads(said[0]) != settings:
        raise ValueError(f"{folder} was made with other settings")
    return spark.read.parquet(f"{folder}/rows")


def missing(cache: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The wanted keys that a cache lacks: it is whole if there are none."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def stored_vectors(vectors: DataFrame, kind: str = "float") -> DataFrame:
    """(node, vector) in the numbers that a cache keeps: float or double."""
    return vectors.select("node", F.col("vector").cast(f"array<{kind}>").alias("vector"))
