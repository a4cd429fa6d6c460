"""A star schema read as a property graph: rows are nodes, foreign keys are edges.

Node ids are kind * 10^10 + key. Parts stand for the focus label, with the variants of labels and image lists that
exports have; edge ids are the edges' places in scan order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "orders": 6}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}
#: Keys in a chunk, of all kinds.
CHUNK = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def state(spark: SparkSession, folder: str) -> tuple:
    """What tells one state of the graph's tables from another: their files' names, sizes and times of change."""
    found = []
    for name in (*KINDS, "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)]
    return tuple(found)


def node_id(kind: str, key: Column | str) -> Column:
    return F.lit(KINDS[kind] * 10**10) + (F.col(key) if isinstance(key, str) else key).cast("long")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """node_id, chunk_id, chunk_pos, wid, labels, images."""

    def of(kind: str) -> DataFrame:
        key = F.col(KEYS[kind]).cast("long")
        label, wid, images = F.lit(kind.upper()), F.concat(F.lit("Q"), node_id(kind, key).cast("string")), F.lit(None)
        if kind == "supplier":
            wid = F.lit(None)
        if kind == "customer":
            wid = F.concat(F.lit("Q"), node_id(kind, F.floor(key / 2)).cast("string"))
        if kind == "part":
            label = F.element_at(F.array(F.lit(" PART"), F.lit("PART"), F.lit("part")), F.pmod(F.col("p_size"), F.lit(3)) + 1)
            good = F.array(F.concat(F.lit("https://img.example/"), key.cast("string"), F.lit(".png")))
            images = F.when(F.col("p_size") % 4 == 0, good).when(F.col("p_size") % 4 == 1, F.array(F.lit("ftp://x"), F.lit(" HTTP://y.jpg"))).when(F.col("p_size") % 4 == 2, F.array().cast("array<string>"))
        chunk = F.floor(key / CHUNK)
        return table(spark, folder, kind).select(node_id(kind, key).alias("node_id"), chunk.cast("int").alias("chunk_id"), (F.lit(KINDS[kind] * CHUNK) + key % CHUNK).cast("int").alias("chunk_pos"), wid.cast("string").alias("wid"), F.array(label).alias("labels"), images.cast("array<string>").alias("images"))

    return reduce(DataFrame.unionByName, map(of, KINDS))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """id, src, dst, type."""
    lines, orders, nation = (table(spark, folder, t) for t in ("lineitem", "orders", "nation"))
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    # Some names have white space around them, some are blank.
    contains = F.when(F.col("l_linenumber") == 6, " CONTAINS ").when(F.col("l_linenumber") == 7, " ").otherwise("CONTAINS")
    row = lambda id_, src, dst, type_: [id_.cast("long").alias("id"), src.alias("src"), dst.alias("dst"), type_.alias("type")]
    base = lambda k: F.lit(k * 10**15)
    parts = [
        lines.select(*row(base(1) + place, node_id("orders", "l_orderkey"), node_id("part", "l_partkey"), contains)),
        lines.select(*row(base(2) + place, node_id("part", "l_partkey"), node_id("supplier", "l_suppkey"), F.lit("SUPPLIED_BY"))),
        orders.select(*row(base(3) + F.col("o_orderkey"), node_id("orders", "o_orderkey"), node_id("customer", "o_custkey"), F.lit("PLACED_BY"))),
        nation.select(*row(base(5) + F.col("n_nationkey"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), F.lit("IN_REGION"))),
    ]
    for kind, nation_key in (("supplier", "s_nationkey"), ("customer", "c_nationkey")):
        id_ = base(4) + node_id(kind, KEYS[kind])
        parts.append(table(spark, folder, kind).select(*row(id_, node_id(kind, KEYS[kind]), node_id("nation", nation_key), F.lit("IN_NATION"))))
    return reduce(DataFrame.unionByName, parts)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """node, vector, label."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vector"), "label")
