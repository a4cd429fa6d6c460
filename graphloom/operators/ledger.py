"""Resumable work: which keys are still to be fetched, what the last record of each says, and output in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_terminal
from .catalog import latest


def terminal_records(records: DataFrame) -> DataFrame:
    """The last record of each wid (pos decides) if it needs no further try."""
    return latest(records, "wid", "pos").filter(is_terminal("status", "url", "brief"))


def pending(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted rows whose wid has no terminal record. A null wid is never done."""
    return wanted.join(terminal_records(records).select("wid"), "wid", "left_anti")


def outputs(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(pos, wid, url, brief): a row for each wanted wid at its first place, with empty texts where there is no record."""
    first = wanted.groupBy("wid").agg(F.min("pos").alias("pos"))
    found = latest(records, "wid", "pos").select("wid", "url", "brief")
    return first.join(found, "wid", "left").select("pos", "wid", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("brief", F.lit("")).alias("brief"))


def filled(wanted: DataFrame, cache: DataFrame, encode, key: str = "node", vector: str = "vector") -> DataFrame:
    """(key, vector) for every wanted key: from the cache, and for those not there from encode(rows)."""
    found = wanted.select(key).distinct().join(cache.select(key, vector), key)
    missing = wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return found.unionByName(encode(missing).select(key, vector))


def hit_rate(wanted: DataFrame, cache: DataFrame, key: str = "node") -> DataFrame:
    """(hits, misses, rate) of lookups in a cache."""
    rows = wanted.select(key).join(cache.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    hits = F.count_if(F.col("hit").isNotNull())
    return rows.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0).alias("rate"))
