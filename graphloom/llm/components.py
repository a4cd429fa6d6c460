"""Connected components by alternating stars: every round each node hangs its neighbours on the least of them.

All work is joins and grouped minima over link rows; nothing is collected but the number of changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the least node reachable. Self-links and repeats do
    no harm; no links give no rows. A node of very many links is only ever aggregated, never gathered."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = written(links)
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = None
    for _ in range(most_rounds):
        # Large star: neighbours that are greater than a node go to the least of the node and its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = written(small.filter("a > b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
