"""Evaluation of link predictions: samples without replacement, scores from stored vectors, whole reports by subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import order_hash
from .metrics import auc_ap


def sampled_rows(rows: DataFrame, keys: list[str], most: int, seed: int | str, within: str | None = None) -> DataFrame:
    """At most `most` rows, of all or of each value of `within`, drawn without replacement: the first in a hash order of
    their keys. Nought or less keeps all rows."""
    if most <= 0:
        return rows
    order = [order_hash(seed, *keys), *map(F.col, keys)]
    if within is None:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(within).orderBy(*order))).filter(F.col("rank__") <= most).drop("rank__")


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def pair_scores(pairs: DataFrame, vectors: DataFrame, first: str, second: str, score=dot) -> DataFrame:
    """pairs with the score of both ends' stored vectors (node, vector). A pair with an end that has none is left out."""
    a = vectors.select(F.col("node").alias(first), F.col("vector").alias("a__"))
    b = vectors.select(F.col("node").alias(second), F.col("vector").alias("b__"))
    return pairs.join(a, first).join(b, second).withColumn("score", score("a__", "b__")).select(*pairs.columns, "score")


def report(positives: DataFrame, negatives: DataFrame, vectors: DataFrame, num_neg: int, cells: list[str], k: int = 10, score=dot) -> DataFrame:
    """(cell, n_pos, n_neg, auc, ap, hit_pos, hit, per_positive), a row for each of cells, zeros where one is empty.

    positives: cell, lo, hi; negatives: cell, lo, hi, neg_lo, neg_hi, the valid ones. AUC and average precision take all
    positives and valid negatives. hit is the share of positives that rank k-th or better among their negatives, ties
    against them, of the hit_pos positives that have all their num_neg negatives.
    """
    scored = pair_scores(positives.select("cell", "lo", "hi"), vectors, "lo", "hi", score)
    drawn = pair_scores(negatives.select("cell", "lo", "hi", "neg_lo", "neg_hi"), vectors, "neg_lo", "neg_hi", score)
    rows = scored.select("cell", "score", F.lit(1).alias("label")).unionByName(drawn.select("cell", "score", F.lit(0).alias("label")))
    goals = scored.select("cell", "lo", "hi", F.col("score").alias("goal"))
    ranks = drawn.join(goals, ["cell", "lo", "hi"]).groupBy("cell", "lo", "hi").agg(F.count("*").alias("n"), (1 + F.count_if(F.col("score") >= F.col("goal"))).alias("rank"))
    hits = ranks.filter(F.col("n") == num_neg).groupBy("cell").agg(F.count("*").alias("hit_pos"), F.avg((F.col("rank") <= k).cast("double")).alias("hit"))
    all_cells = rows.sparkSession.createDataFrame([(c,) for c in cells], "cell string")
    found = all_cells.join(auc_ap(rows, "cell"), "cell", "left").join(hits, "cell", "left")
    found = found.withColumn("per_positive", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast(dict(found.dtypes)[c])).alias(c)
    return found.select("cell", *map(zero, ("n_pos", "n_neg", "auc", "ap", "hit_pos", "hit", "per_positive")))


def image_coverage(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """(hit, none, missing): nodes whose image has a file, that have no image, and whose image has none. paths: wid, path."""
    rows = catalog.join(paths.select("wid").distinct().withColumn("there", F.lit(True)), "wid", "left")
    there = F.col("there").isNotNull()
    return rows.agg(F.count_if(F.col("has_image") & there).alias("hit"), F.count_if(~F.col("has_image")).alias("none"), F.count_if(F.col("has_image") & ~there).alias("missing"))


def chunk_focus_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, edges, art_art, art_any): how many of a chunk's own edges (chunk_id, src_pos, dst_pos) have focus nodes
    at both ends and at one end at least. nodes: chunk_id, chunk_pos, is_art."""
    s = nodes.select("chunk_id", F.col("chunk_pos").alias("src_pos"), F.col("is_art").alias("s"))
    d = nodes.select("chunk_id", F.col("chunk_pos").alias("dst_pos"), F.col("is_art").alias("d"))
    rows = edges.join(s, ["chunk_id", "src_pos"]).join(d, ["chunk_id", "dst_pos"])
    return rows.groupBy("chunk_id").agg(F.count("*").alias("edges"), F.count_if(F.col("s") & F.col("d")).alias("art_art"), F.count_if(F.col("s") | F.col("d")).alias("art_any"))
