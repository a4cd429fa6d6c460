"""A graph as stored tables: hops join it without a shuffle of its edges, and loads of chunks read only their files.

Each node's message edges (src, place, rel, dst, chunk_id) are numbered in a hash order, so a sampler draws numbers and
fetches just these edges. They lie in buckets of (src, place), over which a hub's edges are spread, and within that
they are partitioned by groups of chunks. A table of degrees has buckets of src.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..operators import neighbours as N
from ..operators.neighbours import both_ways, links, shared_folder, stored_adjacency, written
from ..operators.order import partitions

#: Groups of chunks that a table is partitioned by, at most: each group has a file for every bucket.
GROUPS = 64


class GraphStore:
    """Tables of one graph. They are kept in `folder` and known to the session's catalog under the store's name."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, group: int):
        self.spark, self.name, self.buckets, self.group = spark, name, buckets, group

    @classmethod
    def create(cls, edges: DataFrame, homes: DataFrame, seed: int, buckets: int | None = None, folder: str | None = None, name: str | None = None) -> GraphStore:
        """Store message edges (src, rel, dst), as they are, with the chunk of their source: homes has (node, chunk_id) of
        every node. Numbers depend on the seed and the edge only. The edges are read twice.

        They come numbered, as pages by source, which meet their chunk in these buckets: only the numbered edges are shuffled."""
        spark = edges.sparkSession
        name = name or f"graph_{uuid.uuid4().hex}"
        folder, buckets = folder or f"{shared_folder(spark)}/{name}", buckets or partitions(spark)
        last = homes.agg(F.max("chunk_id")).first()[0] or 0
        store = cls(spark, name, buckets, last // GROUPS + 1)
        single, several, wide = stored_adjacency(edges, seed)
        own = homes.select(F.col("node").alias("src"), "chunk_id")
        pages = single.join(own, "src").select("src", F.lit(0).cast("long").alias("first"), "out", "chunk_id")
        degrees = single.select("src", F.size("out").cast("long").alias("degree"))
        if several is not None:
            pages = pages.unionByName(several.join(own, "src").select("src", (F.col("page") * N.PAGE).alias("first"), "out", "chunk_id"))
            degrees = degrees.unionByName(wide)
        rows = pages.select("src", "first", "chunk_id", F.posexplode("out").alias("at", "edge"))
        rows = rows.select("src", "edge.rel", "edge.dst", (F.col("first") + F.col("at")).alias("place"), "chunk_id").withColumn("chunk_group", store._group(F.col("chunk_id")))
        rows = rows.repartition(buckets, "src", "place").sortWithinPartitions("chunk_group", "src", "place").write.option("compression", "zstd")
        rows.partitionBy("chunk_group").bucketBy(buckets, "src", "place").sortBy("src", "place").option("path", f"{folder}/edges").saveAsTable(f"{name}_edges")
        degrees = degrees.join(own.select("src"), "src", "left_semi").repartition(buckets, "src").write.option("compression", "zstd")
        degrees.bucketBy(buckets, "src").sortBy("src").option("path", f"{folder}/degrees").saveAsTable(f"{name}_degrees")
        return store

    def _group(self, chunk):
        return F.floor(chunk / self.group).cast("int")

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(f"{self.name}_edges").select("src", "place", "rel", "dst", "chunk_id")

    @property
    def degrees(self) -> DataFrame:
        return self.spark.table(f"{self.name}_degrees")

    def of_chunk(self, chunk: int) -> DataFrame:
        """The edges that start in one chunk. Only the files of its group are read, and in these only its rows' groups."""
        return self._whole().filter((F.col("chunk_group") == chunk // self.group) & (F.col("chunk_id") == chunk)).drop("chunk_group")

    def of_first(self, chunks: int) -> DataFrame:
        """The edges that start in the first chunks, for samples of a graph; files of later groups aren't read."""
        return self._whole().filter((F.col("chunk_group") <= max(0, chunks - 1) // self.group) & (F.col("chunk_id") < chunks)).drop("chunk_group")

    def _whole(self) -> DataFrame:
        return self.spark.table(f"{self.name}_edges")

    def hop(self, frontier: DataFrame, k: int, seed: int) -> DataFrame:
        """(batch_id, src, rel, dst): of each frontier node's (batch_id, node) edges k, from a place on that is drawn for batch
        and node; all of them, if there are no more. The frontier and its draws are shuffled, the store is not."""
        at = frontier.select("batch_id", F.col("node").alias("src")).repartition(self.buckets, "src").join(self.degrees, "src")
        start = draw(F.col("degree"), f"{seed}:start", "batch_id", "src")
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(k).cast("long"), F.col("degree")) - 1))
        places = at.select("batch_id", "src", steps.alias("step"), "degree", start.alias("start"))
        places = places.select("batch_id", "src", F.pmod(F.col("start") + F.col("step"), F.col("degree")).alias("place"))
        return places.join(self._whole().select("src", "place", "rel", "dst"), ["src", "place"]).select("batch_id", "src", "rel", "dst")

    def sample(self, seeds: DataFrame, fan_out: list[int], hops: int, seed: int) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of every batch, as operators.neighbours.sampled gives them over the same edges."""
        nodes = written(seeds.select("batch_id", "node").distinct().withColumn("hop", F.lit(0)))
        frontier, picked = nodes, None
        for hop in range(hops):
            taken = written(self.hop(frontier, fan_out[min(hop, len(fan_out) - 1)], seed).withColumn("hop", F.lit(hop + 1)))
            picked = taken if picked is None else picked.unionByName(taken)
            reached = taken.select("batch_id", F.col("dst").alias("node")).distinct()
            frontier = written(reached.join(nodes, ["batch_id", "node"], "left_anti").withColumn("hop", F.lit(hop + 1)))
            nodes = nodes.unionByName(frontier)
        return nodes, picked

    def drop(self) -> None:
        """Forget the tables; their files stay until their folder goes."""
        for table in ("edges", "degrees"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def store_of(triples: DataFrame, catalog: DataFrame, seed: int, buckets: int | None = None) -> GraphStore:
    """The store of a graph's triples (h, r, t), in both directions, each once, by its catalog's chunks."""
    edges = both_ways(written(links(triples)))
    return GraphStore.create(edges, catalog.select(F.col("node_idx").alias("node"), "chunk_id"), seed, buckets)
