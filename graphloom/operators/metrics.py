"""Evaluation as aggregations: AUC, average precision, filtered ranks, MRR, hits, per subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import SCORERS


#: Bytes of a list of relations that is sent to all tasks at one time.
MOST_BYTES = 32 << 20
SUBSETS = ("global", "art_art", "art_any")


def for_all_subsets(rows: DataFrame, **empty: float | int) -> DataFrame:
    """rows by subset, with a row of the given values for a subset that has none."""
    names = rows.sparkSession.createDataFrame([(s,) for s in SUBSETS], "subset string")
    out = F.broadcast(names).join(rows, "subset", "left")
    return out.select("subset", *[F.coalesce(F.col(c), F.lit(empty[c]).cast(kind)).alias(c) if c in empty else F.col(c) for c, kind in rows.dtypes if c != "subset"])


def auc_ap(scores: DataFrame, group: str, score: str = "score", label: str = "label") -> DataFrame:
    """(group, n_pos, n_neg, auc, ap): area under the ROC curve over different scores, and average precision. A group of
    one class has 0.5 and 0."""
    cells = scores.groupBy(group, F.col(score).alias("s__")).agg(F.sum(F.col(label).cast("long")).alias("p__"), F.sum(1 - F.col(label).cast("long")).alias("n__"))
    # Sums so far are made in 1024 parts of each group's range of scores, so a large group has no window of its own.
    ends = scores.groupBy(group).agg(F.min(score).alias("low__"), F.max(score).alias("high__"))
    part = F.when(F.col("high__") > F.col("low__"), F.floor((F.col("high__") - F.col("s__")) / (F.col("high__") - F.col("low__")) * 1023)).otherwise(0).cast("int")
    rows = cells.join(ends, group).withColumn("part__", part)
    before = Window.partitionBy(group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(group, "part__").agg(F.sum("p__").alias("p0"), F.sum("n__").alias("n0"))
    heads = heads.select(group, "part__", F.coalesce(F.sum("p0").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n0").over(before), F.lit(0)).alias("n0"))
    totals = cells.groupBy(group).agg(F.sum("p__").alias("n_pos"), F.sum("n__").alias("n_neg"))
    inside = Window.partitionBy(group, "part__").orderBy(F.desc("s__")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(heads, [group, "part__"]).withColumns({"tp": F.sum("p__").over(inside) + F.col("p0"), "fp": F.sum("n__").over(inside) + F.col("n0")})
    # Trapezoids over (fp, tp); steps of recall times precision.
    area = F.sum(F.col("n__") * (F.col("tp") - F.col("p__") / 2.0))
    precision = F.sum(F.col("p__") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    out = sums.groupBy(group).agg(area.alias("area"), precision.alias("precision")).join(totals, group)
    one = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return out.select(group, "n_pos", "n_neg", F.when(one, 0.5).otherwise(F.col("area") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), F.when(one, 0.0).otherwise(F.col("precision") / F.col("n_pos")).alias("ap"))


def scored(triples: DataFrame, entities: DataFrame, relations: DataFrame, scorer: str) -> DataFrame:
    """triples (h, r, t) with their score; entities (node, vector), relations (r, vector)."""
    h = entities.select(F.col("node").alias("h"), F.col("vector").alias("h_vector"))
    t = entities.select(F.col("node").alias("t"), F.col("vector").alias("t_vector"))
    r = relations.select("r", F.col("vector").alias("r_vector"))
    out = triples.join(h, "h").join(t, "t").join(r, "r")
    return out.withColumn("score", SCORERS[scorer]("h_vector", "r_vector", "t_vector")).select(*triples.columns, "score")


def score_lists(queries: DataFrame, entities: DataFrame, relations: DataFrame, scorer: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """queries (qid, h, t, …) with scores: array of (r, score), one for each relation, in the order of r.

    A pair stays one row: the relations are a list that every row runs over. It is sent to all tasks in parts of most_bytes
    at most; where there are several, the parts of a query's list are put together again.
    """
    size = relations.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    parts = max(1, -(-size["n"] * ((size["dims"] or 0) * 8 + 16) // most_bytes))
    lists = relations.groupBy(F.pmod(F.xxhash64("r"), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list(F.struct("r", "vector"))).alias("relations"))
    h = entities.select(F.col("node").alias("h"), F.col("vector").alias("h_vector"))
    t = entities.select(F.col("node").alias("t"), F.col("vector").alias("t_vector"))
    scores = F.transform("relations", lambda x: F.struct(x["r"].alias("r"), SCORERS[scorer]("h_vector", x["vector"], "t_vector").alias("score")))
    rows = queries.join(h, "h").join(t, "t").crossJoin(F.broadcast(lists)).select(*queries.columns, scores.alias("scores"))
    if parts > 1:
        rows = rows.groupBy(*queries.columns).agg(F.array_sort(F.flatten(F.collect_list("scores"))).alias("scores"))
    return rows


def _best_first(scores: Column | str) -> Column:
    """(score, minus): best first, ties by the relation's number, whose negative minus is."""
    return F.sort_array(F.transform(scores, lambda x: F.struct(x["score"].alias("score"), (-x["r"]).alias("minus"))), asc=False)


def top_relations(scored_: DataFrame, k: int) -> DataFrame:
    """(qid, r, rank, score) of the k best relations of each query's list, ties by number; nothing is filtered."""
    best = scored_.select("qid", F.posexplode(F.slice(_best_first("scores"), 1, k)).alias("at", "x"))
    return best.select("qid", (-F.col("x.minus")).alias("r"), (F.col("at") + 1).alias("rank"), F.col("x.score").alias("score"))


def filtered_ranks(scored_: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, r, rank, top1): the target's rank among relations that aren't otherwise true of the pair, ties in its favour,
    and the best of them. scored_: qid, h, t, r, scores; known: h, r, t. One shuffle, by pair; a query whose
    target has no score is left out."""
    true = known.groupBy("h", "t").agg(F.collect_set("r").alias("known"))  # of a pair, at most all relations
    rows = scored_.join(true, ["h", "t"], "left").withColumn("known", F.coalesce("known", F.array().cast(true.schema["known"].dataType)))
    rows = rows.withColumn("goal", F.get(F.filter("scores", lambda x: x["r"] == F.col("r")), 0)["score"]).filter("goal IS NOT NULL")
    open_ = F.filter("scores", lambda x: (x["r"] == F.col("r")) | ~F.array_contains("known", x["r"]))
    rows = rows.select("qid", "r", "goal", open_.alias("open"))
    better = F.size(F.filter("open", lambda x: x["score"] > F.col("goal")))
    return rows.select("qid", "r", (1 + better).cast("long").alias("rank"), (-F.get(_best_first("open"), 0)["minus"]).alias("top1"))


def ranking(ranks: DataFrame, group: Column | str) -> DataFrame:
    """MRR, hits at 1, 3 and 10, and how often the best relation is the target."""
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 10)]
    return ranks.groupBy(group).agg(F.count("*").alias("n"), F.avg(1.0 / F.col("rank")).alias("mrr"), *hits, F.avg((F.col("top1") == F.col("r")).cast("double")).alias("top1"))


def hit_at(scores: DataFrame, k: int, group: str) -> DataFrame:
    """(group, n, hit): the share of queries (qid) whose positive ranks k-th or better among its negatives, ties against it."""
    rows = scores.groupBy(group, "qid").agg(F.max(F.when(F.col("label") == 1, F.col("score"))).alias("pos"), F.collect_list(F.when(F.col("label") == 0, F.col("score"))).alias("neg"))
    rank = F.size(F.filter("neg", lambda x: x >= F.col("pos"))) + 1
    return rows.filter("pos IS NOT NULL").groupBy(group).agg(F.count("*").alias("n"), F.avg((rank <= k).cast("double")).alias("hit"))


def in_subsets(rows: DataFrame, h_flag: str = "h_flag", t_flag: str = "t_flag") -> DataFrame:
    """rows once for each subset they are in: global, art_art, art_any."""
    from .catalog import subsets

    return rows.withColumn("subset", subsets(F.col(h_flag) & F.col(t_flag), F.col(h_flag) | F.col(t_flag)))
