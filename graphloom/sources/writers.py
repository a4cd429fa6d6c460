"""Writers of exports, scores, texts and caches. Spark's committer makes each of them whole or absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_export(nodes: DataFrame, edges: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write nodes and edges by chunk_id (an edge is in its source's chunk) and return the manifest rows: chunk_id,
    node_count, edge_count, low, high."""
    owners = nodes.select(F.col("node_id").alias("src"), "chunk_id")
    placed = edges.join(owners, "src")
    nodes.repartition("chunk_id").sortWithinPartitions("chunk_id", "node_id").write.mode(mode).partitionBy("chunk_id").parquet(f"{folder}/nodes")
    placed.repartition("chunk_id").sortWithinPartitions("chunk_id", "src", "id").write.mode(mode).partitionBy("chunk_id").parquet(f"{folder}/edges")
    rows = manifest(nodes, edges)
    rows.write.mode(mode).json(f"{folder}/manifest")
    return rows


def node_list(nodes: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Nodes as JSON lines in the order of their ids."""
    nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode(mode).json(folder)


def node_array(nodes: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Nodes as one JSON list in the order of their ids, in one file: for lists that another program reads whole. Its lines
    pass through one writer; what is large belongs into node_list."""
    least = nodes.agg(F.min("node_id")).first()[0]
    line = F.concat(F.when(F.col("node_id") == least, "[").otherwise(","), F.to_json(F.struct(*nodes.columns), {"ignoreNullFields": "false"}))
    end = nodes.agg(F.when(F.count("*") == 0, "[]").otherwise("]").alias("value"), F.lit(None).cast("long").alias("node_id"))
    lines = nodes.select(line.alias("value"), "node_id").unionByName(end)
    lines.repartition(1).sortWithinPartitions(F.asc_nulls_last("node_id")).select("value").write.mode(mode).text(folder)


def metrics_rows(rows: DataFrame, folder: str) -> None:
    """Add rows of metrics to a folder of CSV."""
    rows.write.mode("append").option("header", True).csv(folder)


def vectors_back(cached: DataFrame, fresh: DataFrame, folder: str, key: str = "node") -> DataFrame:
    """Write cached vectors and those made since, where both have a key the fresh one, and read them again."""
    stale = cached.join(fresh.select(key), key, "left_anti")
    fresh.unionByName(stale).write.mode("errorifexists").parquet(folder)
    return cached.sparkSession.read.parquet(folder)


def manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_id, node_count, edge_count, low, high."""
    counts = nodes.groupBy("chunk_id").agg(F.count("*").alias("node_count"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    own = edges.join(nodes.select(F.col("node_id").alias("src"), "chunk_id"), "src").groupBy("chunk_id").agg(F.count("*").alias("edge_count"))
    return counts.join(own, "chunk_id", "left").select("chunk_id", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "low", "high")


def resumed(nodes: DataFrame, last: int | None) -> DataFrame:
    """The nodes an export still has to write: those after the last one written."""
    return nodes if last is None else nodes.filter(F.col("node_id") > last)


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, src_type, dst, dst_type, type: labels joined by a pipe, blank if there are none."""
    names = nodes.select("node_id", F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "|").alias("name"))
    s = names.select(F.col("node_id").alias("src"), F.col("name").alias("src_type"))
    d = names.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_type"))
    return edges.join(s, "src").join(d, "dst").select("src", "src_type", "dst", "dst_type", "type")


def tab_separated(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(folder)


def text_shards(outputs: DataFrame, folder: str, per_file: int = 1000, mode: str = "errorifexists") -> None:
    """(pos, …) rows in order of pos, at most per_file in a file."""
    outputs.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos").write.mode(mode).option("maxRecordsPerFile", per_file).json(folder)


def appended(rows: DataFrame, folder: str) -> None:
    """Add rows to a ledger of JSON lines."""
    rows.write.mode("append").json(folder)


def scores(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, or CSV with nested columns as JSON."""
    if path.lower().endswith(".csv"):
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.select(*[F.to_json(c).alias(f"{c}_json") if c in nested else F.col(c) for c in df.columns]).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).json(path)


def config_json(config: object) -> str:
    from dataclasses import asdict

    return json.dumps(asdict(config), indent=2, sort_keys=True)
