"""Counts of nodes, relationships, label sets, degrees and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import partitions


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def label_counts(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Label sets, in the order the labels stand, by their number of nodes."""
    return nodes.groupBy("labels").count().select(F.array_join("labels", "|").alias("labels"), F.col("count").alias("cnt")).orderBy(F.desc("cnt"), "labels").limit(most)


def type_counts(edges: DataFrame, most: int = 10) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "type").limit(most)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): outgoing edges, nodes without any included."""
    counts = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def row_pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, node_id, degree, row_ptr): where each node's edges begin among its chunk's, which are sorted by source."""
    rows = degrees(nodes, edges).join(nodes.select("node_id", "chunk_id"), "node_id")
    before = Window.partitionBy("chunk_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("chunk_id", "node_id", "degree", F.coalesce(F.sum("degree").over(before), F.lit(0)).alias("row_ptr"))


def chunk_shares(edges: DataFrame) -> DataFrame:
    """(chunk_id, n, share): each chunk's edges and their share of all. One row a chunk, so the window is small."""
    counts = edges.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def rolling(df: DataFrame, series: str, step: str, value: str, width: int, parts: int | None = None) -> DataFrame:
    """Mean, population deviation and variance of the last `width` values of each series, whose steps differ.

    The step axis is cut into parts of about equal rows, and every part of a series is a window of its own that begins with
    the width - 1 rows before it, so that a long series is the work of many tasks. A null step stands first.
    """
    n = parts or partitions(df.sparkSession)
    cuts = df.agg(F.percentile_approx(step, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(step))) if cuts else F.lit(0)
    rows = df.select(F.col(series).alias("series"), F.col(step).alias("step"), F.col(value).alias("value"), F.when(F.col(step).isNull(), 0).otherwise(part).alias("part"))
    # The last rows of each part: a part's predecessors are among those of the parts before it.
    last = Window.partitionBy("series", "part").orderBy(F.desc_nulls_last("step"))
    tails = rows.withColumn("at", F.row_number().over(last)).filter(F.col("at") < width).drop("at")
    before = Window.partitionBy("series").orderBy(F.asc_nulls_first("step")).rowsBetween(2 - width, 0)
    tails = tails.withColumn("near", F.collect_list(F.struct("step", "value")).over(before)) if width > 1 else tails.withColumn("near", F.array().cast("array<struct<step:long,value:double>>"))
    ends = tails.groupBy("series", "part").agg(F.max_by("near", F.struct(F.col("step").isNotNull(), "step")).alias("near"))
    carried = ends.withColumn("near", F.lag("near").over(Window.partitionBy("series").orderBy("part"))).select("series", "part", F.explode("near").alias("x"))
    carried = carried.select("series", "x.step", "x.value", "part", F.lit(False).alias("own"))
    order = Window.partitionBy("series", "part").orderBy("own", F.asc_nulls_first("step")).rowsBetween(1 - width, 0)
    out = rows.withColumn("own", F.lit(True)).unionByName(carried) if width > 1 else rows.withColumn("own", F.lit(True))
    out = out.withColumns({"mean": F.avg("value").over(order), "std": F.stddev_pop("value").over(order), "var": F.var_pop("value").over(order)})
    return out.filter("own").select(F.col("series").alias(series), F.col("step").alias(step), "mean", "std", "var")


def last_rolling(df: DataFrame, series: str, step: str, value: str, width: int) -> DataFrame:
    """(series, n, mean, std, var) of the last `width` values of each series alone; no window over a whole series is made."""
    order = Window.partitionBy(series).orderBy(F.desc(step))
    last = df.withColumn("rank__", F.row_number().over(order)).filter(F.col("rank__") <= width)
    return last.groupBy(series).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"))


def early_stop(df: DataFrame, run: str, step: str, metric: str, min_delta: float, patience: int) -> DataFrame:
    """Of each run's evaluations: the best so far, whether this one is better by over min_delta, evaluations since then,
    and whether the run has stopped by now.

    With min_delta above nought the best only moves by more than that, so the series is folded in order; it is as long
    as a run has evaluations.
    """
    row = F.struct(F.col(step).alias("step"), F.col(metric).cast("double").alias("value"))
    series = df.groupBy(run).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    state = "struct<best:double,idle:int,stopped:boolean,out:array<struct<step:long,value:double,best:double,improved:boolean,idle:int,stopped:boolean>>>"
    first = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("idle"), F.lit(False).alias("stopped"), F.array().alias("out")).cast(state)

    def fold(s, x):
        improved = x["value"] > s["best"] + min_delta
        best, idle = F.when(improved, x["value"]).otherwise(s["best"]), F.when(improved, 0).otherwise(s["idle"] + 1)
        stopped = s["stopped"] | ((F.lit(patience) > 0) & (idle >= patience))
        out = F.struct(x["step"].cast("long").alias("step"), x["value"].alias("value"), best.alias("best"), improved.alias("improved"), idle.alias("idle"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), idle.alias("idle"), stopped.alias("stopped"), F.concat(s["out"], F.array(out)).alias("out")).cast(state)

    return series.select(run, F.inline(F.aggregate("rows", first, fold)["out"]))


def chunk_sizes(total: int, target: int = 20_000, least: int = 10_000, most: int = 30_000) -> list[int]:
    """Sizes of the chunks that `total` nodes are dealt into: near the target, one apart at most."""
    if total <= 0:
        return []
    wanted = max(1, round(total / target), -(-total // most))
    count = min(wanted, max(1, total // least))
    return [total // count + (k < total % count) for k in range(count)]


def chunk_plan(nodes: DataFrame, target: int = 20_000, least: int = 10_000, most: int = 30_000) -> DataFrame:
    """(chunk_index, node_count, low, high, name): nodes in order of their ids, dealt into chunks.

    The boundaries are the nodes at the chunks' first places; only the chunks' rows come together.
    """
    from ..functions.text import chunk_name
    from .order import numbered

    # Ids are numbered by ranges of about equal width: 4096 of them between the least and the greatest.
    low, high, total = nodes.agg(F.min("node_id"), F.max("node_id"), F.count("*")).first()
    sizes = chunk_sizes(total, target, least, most)
    if not sizes:
        return nodes.sparkSession.createDataFrame([], "chunk_index long, node_count long, low long, high long, name string")
    width = max(1, (high - low + 4096) // 4096)
    placed = numbered(nodes.select("node_id"), "place", F.floor((F.col("node_id") - F.lit(low)) / width).cast("long"), [F.col("node_id")])
    small, n_large = sizes[-1], sum(s > sizes[-1] for s in sizes)
    edge = n_large * (small + 1)
    chunk = F.when(F.col("place") < edge, F.floor(F.col("place") / (small + 1))).otherwise(n_large + F.floor((F.col("place") - edge) / small)).cast("long")
    out = placed.groupBy(chunk.alias("chunk_index")).agg(F.count("*").alias("node_count"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    return out.withColumn("name", chunk_name("chunk_index", "low", "high"))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """What is wrong with an export's manifest rows (chunk_index, node_count, edge_count, low, high, completed_nodes,
    completed_edges): one row for each fault, none if a run may go on from it."""
    sums = manifest.agg(F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"), F.max("completed_nodes").alias("said_nodes"), F.max("completed_edges").alias("said_edges"), F.count("*").alias("n"), F.max("chunk_index").alias("last"))
    whole = sums.select(F.explode(F.filter(F.array(F.when(F.col("nodes") != F.col("said_nodes"), "node counts"), F.when(F.col("edges") != F.col("said_edges"), "edge counts"), F.when(F.col("last") + 1 != F.col("n"), "chunk indexes")), lambda x: x.isNotNull())).alias("fault"))
    order = Window.orderBy("chunk_index")  # one row a chunk
    steps = manifest.withColumn("before", F.lag("high").over(order)).filter("low > high OR before >= low").select(F.concat(F.lit("range of chunk "), F.col("chunk_index").cast("string")).alias("fault"))
    return whole.unionByName(steps)
