"""One query per corpus operator, over the whole of its table and with production parameters.

Every callable takes (spark, folder of Parquet tables). ORACLE_SQL has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, decontaminate, forest, html, lm, neardup, packing, periods, quality, sharding, spelling, suffixes, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, folder, "documents"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op8_fuzzy_passages(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.fuzzy_passages(_table(spark, folder, "documents"))


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents")).withColumn("piece", F.col("piece").cast("int"))


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.nearest(_table(spark, folder, "embeddings"), queried=F.col("vec_id") % 20 == 0)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(_table(spark, folder, "documents"), repeated=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.forms(spelling.counted(_table(spark, folder, "documents"), dropped=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_lm_score, op3_shards, op4_main_text, op5_leaks, op6_token_counts, op7_near_duplicates, op8_fuzzy_passages, op9_repeated_passages, op10_packing, op11_nearest, op12_periodic_runs, op13_spellings)
}

# Links of all pairs that share a shingle, then the least doc_id reachable.
_NEAR = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.both >= 75 * (x.n + y.n - p.both)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (
    SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id))::BIGINT AS component_id,
       d.doc_id <= coalesce(l.other, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op7_near_duplicates": _NEAR}
