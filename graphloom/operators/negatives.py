"""Negative samples by rejection as set logic: every draw is a hash, known rows are joined away, the first valid draw stays.

The reference's loop is over rounds of draws; here `tries` draws of each row are made at once for the rows that are still
open, one first, then a few, then all. A row without a valid draw gets none and is marked so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw, order_hash
from .catalog import MOST_SENT, sent
from .neighbours import written

#: Draws after which a round ends, before the last: nearly every row has a valid draw at once, so a first round of one try
#: shuffles a row for each positive, and the others only what is still open.
ROUNDS = (1, 6)


def _first_valid(rows: DataFrame, key: list[str], draws, known: DataFrame, on: list[str], bad: Column, tries: int) -> DataFrame:
    """(key, *on, try, valid): each row's first draw that is neither bad nor known; nulls, and not valid, if there is none.
    draws: rows and a column of try numbers to rows with the columns `on`. Rows of one key stay as many.

    A round writes its rows with what they found; only those that found nothing are read by the next, so rows and finds are
    never joined."""
    ends = [*(n for n in ROUNDS if n < tries), tries]
    truth, open_, found = known.select(*on).distinct().withColumn("known", F.lit(True)), rows, None
    for low, high in zip([0, *ends], ends, strict=False):
        tried, of = draws(open_.withColumn("try", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))), truth
        if found is not None:
            few = open_.limit(MOST_SENT // (high - low) + 1).count()
            if not few:
                break
            if few * (high - low) <= MOST_SENT:
                # What is known of a few draws is told without a shuffle of all that is known.
                tried = written(tried)
                of = known.select(*on).join(F.broadcast(tried.select(*on)), on, "left_semi").distinct().withColumn("known", F.lit(True))
        tried = tried.join(of, on, "left")
        valid = ~F.coalesce(bad, F.lit(True)) & F.col("known").isNull()
        if high - low == 1:
            drawn = tried.select(*key, *[F.when(valid, F.col(c)).alias(c) for c in (*on, "try")], F.coalesce(valid, F.lit(False)).alias("valid"))
        else:
            best = tried.groupBy(*key).agg(F.min(F.when(valid, F.struct("try", *on))).alias("x"), (F.count("*") / (high - low)).cast("int").alias("n"))
            drawn = best.select(*key, *[F.col(f"x.{c}").alias(c) for c in (*on, "try")], F.col("x").isNotNull().alias("valid"), F.explode(F.sequence(F.lit(1), "n")).alias("n")).drop("n")
        drawn = written(drawn)
        done = drawn.filter("valid")
        found, open_ = done if found is None else found.unionByName(done), drawn.filter("NOT valid").select(*key)
        none = drawn.filter("NOT valid")
    return found.unionByName(none)


def _copied(rows: DataFrame, num_neg: int) -> tuple[DataFrame, list[str]]:
    """Each row num_neg times, with the column `copy` if there are several, and the columns that a draw depends on besides."""
    if num_neg == 1:
        return rows, []
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(num_neg - 1)))), ["copy"]


def _drawn(rows: DataFrame, name: str, pool: DataFrame | int, seed: int | str, *columns: str) -> DataFrame:
    """rows with an entity drawn: a number below pool, or a node of the pool (place from 0, node), joined by its place."""
    if isinstance(pool, int):
        return rows.withColumn(name, draw(pool, seed, *columns))
    n = pool.count()
    return rows.withColumn("place", draw(n, seed, *columns)).join(sent(pool.select("place", F.col("node").alias(name))), "place").drop("place")


def of_triples(positives: DataFrame, known: DataFrame, n_entities: int, seed: int, tries: int = 50, num_neg: int = 1, pool: DataFrame | None = None) -> DataFrame:
    """(h, r, t, neg_h, neg_t, valid), with num_neg rows and a column copy for each triple if num_neg is not 1: its head or
    tail replaced (a hash bit says which) by any entity, or one of the pool (place from 0, node), such that it is no known
    triple and no self-loop. An empty pool is an error."""
    rows, copy = _copied(positives.select("h", "r", "t"), num_neg)
    side = F.pmod(order_hash(f"{seed}:side", "h", "r", "t", *copy), F.lit(2)) == 0
    if pool is not None and pool.isEmpty():
        raise ValueError("the pool of candidates is empty")

    def draws(open_: DataFrame) -> DataFrame:
        tried = _drawn(open_, "other", n_entities if pool is None else pool, seed, "h", "r", "t", *copy, "try")
        return tried.withColumns({"neg_h": F.when(side, F.col("other")).otherwise(F.col("h")), "neg_t": F.when(side, F.col("t")).otherwise(F.col("other"))})

    truth = known.select(F.col("h").alias("neg_h"), F.col("r"), F.col("t").alias("neg_t"))
    truth = truth.withColumnRenamed("r", "neg_r")
    found = _first_valid(rows, ["h", "r", "t", *copy], lambda open_: draws(open_).withColumn("neg_r", F.col("r")), truth, ["neg_h", "neg_r", "neg_t"], F.col("neg_h") == F.col("neg_t"), tries)
    return found.select("h", "r", "t", *copy, "neg_h", "neg_t", "valid")


def of_pairs(positives: DataFrame, known: DataFrame, pool: DataFrame, seed: int, tries: int = 50, num_neg: int = 1) -> DataFrame:
    """(lo, hi, neg, valid), with num_neg rows and a column copy for each pair if num_neg is not 1: its lo with another end
    from the pool (place from 0, node) such that the unordered pair is not known and no self-loop. The pool is joined by
    the place that is drawn, never gathered. An empty pool gives rows that are not valid."""
    rows, copy = _copied(positives.select("lo", "hi"), num_neg)
    if pool.isEmpty():
        return rows.withColumns({"neg": F.lit(None).cast("long"), "valid": F.lit(False)})

    def draws(open_: DataFrame) -> DataFrame:
        return _drawn(open_, "neg", pool, seed, "lo", "hi", *copy, "try").withColumns({"first": F.least("lo", "neg"), "second": F.greatest("lo", "neg")})

    truth = known.select(F.col("lo").alias("first"), F.col("hi").alias("second"))
    found = _first_valid(rows, ["lo", "hi", *copy], draws, truth, ["first", "second"], F.col("first") == F.col("second"), tries)
    return found.select("lo", "hi", *copy, F.when(F.col("first") == F.col("lo"), F.col("second")).otherwise(F.col("first")).alias("neg"), "valid")


def of_pairs_any(positives: DataFrame, known: DataFrame, focus: DataFrame, others: DataFrame, seed: int, tries: int = 100, num_neg: int = 1) -> DataFrame:
    """(lo, hi, neg_lo, neg_hi, valid), with a column copy if num_neg is not 1: pairs that have a focus node at one end at
    least. A hash bit says whether both ends are drawn, one from the focus nodes and one from the others, or lo stays and
    the other end is a focus node. Either pool being empty gives rows that are not valid."""
    rows, copy = _copied(positives.select("lo", "hi"), num_neg)
    if focus.isEmpty() or others.isEmpty():
        return rows.withColumns({"neg_lo": F.lit(None).cast("long"), "neg_hi": F.lit(None).cast("long"), "valid": F.lit(False)})
    both = F.pmod(order_hash(f"{seed}:side", "lo", "hi", *copy), F.lit(2)) == 0

    def draws(open_: DataFrame) -> DataFrame:
        key = ["lo", "hi", *copy, "try"]
        tried = _drawn(_drawn(open_, "art", focus, seed, *key), "other", others, f"{seed}:other", *key)
        end = F.when(both, F.col("other")).otherwise(F.col("lo"))
        return tried.withColumns({"neg_lo": F.least("art", end), "neg_hi": F.greatest("art", end)})

    truth = known.select(F.col("lo").alias("neg_lo"), F.col("hi").alias("neg_hi"))
    found = _first_valid(rows, ["lo", "hi", *copy], draws, truth, ["neg_lo", "neg_hi"], F.col("neg_lo") == F.col("neg_hi"), tries)
    return found.select("lo", "hi", *copy, "neg_lo", "neg_hi", "valid")


def of_directed(positives: DataFrame, known: DataFrame, n_entities: int, seed: int, tries: int = 50, num_neg: int = 1) -> DataFrame:
    """(src, dst, neg, valid), with a column copy if num_neg is not 1: src with another end such that the edge, in this
    direction, is not known and no self-loop."""
    rows, copy = _copied(positives.select("src", "dst"), num_neg)

    def draws(open_: DataFrame) -> DataFrame:
        return _drawn(open_, "neg", n_entities, seed, "src", "dst", *copy, "try").withColumn("from", F.col("src"))

    truth = known.select(F.col("src").alias("from"), F.col("dst").alias("neg"))
    found = _first_valid(rows, ["src", "dst", *copy], draws, truth, ["from", "neg"], F.col("from") == F.col("neg"), tries)
    return found.select("src", "dst", *copy, "neg", "valid")
