"""Splits into train, val and test: by relation, of undirected pairs, repaired and checked; batches of an epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import draw, order_hash
from .catalog import sent
from .neighbours import undirected, written
from .order import hash_bucket, numbered, permuted


def split_counts(size: Column, val: float, test: float) -> tuple[Column, Column]:
    """How many rows of a relation go to val and to test: whole parts, one at least from ten rows on, none if all would."""
    least = F.when(size >= 10, 1).otherwise(0)
    n_val, n_test = F.greatest(least, F.floor(size * val)), F.greatest(least, F.floor(size * test))
    none = n_val + n_test >= size
    return F.when(none, 0).otherwise(n_val), F.when(none, 0).otherwise(n_test)


def by_relation(triples: DataFrame, val: float, test: float, rare: int, seed: int) -> DataFrame:
    """triples (h, r, t) with split: of each relation the first rows in a hash order are test, the next val, the rest
    train. A relation with at most `rare` rows is all train.

    A relation may hold most of all rows, so its rows are counted in parts of the hash order. All but the parts in which a
    relation's split changes, two at most, are of one split: only their rows are shuffled and ranked.
    """
    rows = triples.withColumn("hash__", order_hash(seed, "h", "r", "t")).withColumn("part__", hash_bucket("hash__"))
    own = Window.partitionBy("r")
    before = own.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("r", "part__").agg(F.count("*").alias("n__"))
    parts = parts.select("*", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"), F.sum("n__").over(own).alias("size__"))
    n_val, n_test = (F.when(F.col("size__") <= rare, 0).otherwise(n) for n in split_counts(F.col("size__"), val, test))
    parts = parts.select("r", "part__", "before__", (F.col("before__") + F.col("n__")).alias("after__"), n_test.alias("test__"), (n_test + n_val).alias("held__"))
    of = lambda first, last: F.when(last < F.col("test__"), "test").when((first >= F.col("test__")) & (last < F.col("held__")), "val").when(first >= F.col("held__"), "train")
    parts = written(parts.select("r", "part__", "before__", "test__", "held__", of(F.col("before__"), F.col("after__") - 1).alias("split")))
    # Hashes are made again rather than written with all rows, most of which need no more than their part's split.
    placed = rows.join(sent(parts), ["r", "part__"])
    cut = written(placed.filter("split IS NULL"))
    place = F.col("before__") + F.row_number().over(Window.partitionBy("r", "part__").orderBy("hash__", "h", "t")) - 1
    ranked = cut.withColumn("place__", place).withColumn("split", of(F.col("place__"), F.col("place__")))
    return placed.filter("split IS NOT NULL").select(*triples.columns, "split").unionByName(ranked.select(*triples.columns, "split"))


def repaired(split: DataFrame) -> DataFrame:
    """Rows of val and test with an end that no train row has go to train. One pass is enough: it only adds train ends."""
    train = split.filter("split = 'train'")
    seen = train.select(F.col("h").alias("node")).unionByName(train.select(F.col("t").alias("node"))).distinct()
    h = seen.select(F.col("node").alias("h"), F.lit(True).alias("h_seen"))
    t = seen.select(F.col("node").alias("t"), F.lit(True).alias("t_seen"))
    rows = split.join(h, "h", "left").join(t, "t", "left")
    return rows.withColumn("split", F.when(F.col("h_seen") & F.col("t_seen"), F.col("split")).otherwise("train")).select(*split.columns)


def of_pairs(edges: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """(lo, hi, split): different unordered pairs in a hash order; whole parts are train and val, the rest is test.

    The order is counted in parts of the hash's range; only pairs of a part in which the split changes, two at most, are ranked."""
    pairs = written(undirected(edges)).withColumn("hash__", order_hash(seed, "lo", "hi")).withColumn("part__", hash_bucket("hash__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(pairs.groupBy("part__").agg(F.count("*").alias("n__")))
    n = parts.agg(F.sum("n__")).first()[0] or 0
    n_train, n_val = int(n * train), int(n * val)
    if n and n - n_train - n_val <= 0:
        raise ValueError("no pair is left for test")
    of = lambda first, last: F.when(last < n_train, "train").when((first >= n_train) & (last < n_train + n_val), "val").when(first >= n_train + n_val, "test")
    parts = parts.withColumn("before__", F.coalesce(F.sum("n__").over(before), F.lit(0)))
    parts = parts.select("part__", "before__", of(F.col("before__"), F.col("before__") + F.col("n__") - 1).alias("split"))
    placed = pairs.join(F.broadcast(parts), "part__")  # a row a part
    place = F.col("before__") + F.row_number().over(Window.partitionBy("part__").orderBy("hash__", "lo", "hi")) - 1
    ranked = placed.filter("split IS NULL").withColumn("place__", place).withColumn("split", of(F.col("place__"), F.col("place__")))
    return placed.filter("split IS NOT NULL").select("lo", "hi", "split").unionByName(ranked.select("lo", "hi", "split"))


def overlaps(split: DataFrame, keys: list[str]) -> DataFrame:
    """(first, second, n): how many keys two splits share; all three pairs are given."""
    seen = split.groupBy(*keys).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    sums = seen.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0)).alias(f"{x}_{y}") for x, y in pairs])
    rows = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(f"{x}_{y}").cast("long").alias("n")) for x, y in pairs])
    return sums.select(F.inline(rows))


def epoch_batches(rows: DataFrame, keys: list[str], size: int, seed: int, epoch: int) -> DataFrame:
    """rows with batch_id: an epoch's order, cut into batches of `size`."""
    hashed = rows.withColumn("hash__", order_hash(f"{seed}:{epoch}", *keys))
    placed = numbered(hashed, "place__", hash_bucket("hash__"), [F.col("hash__"), *map(F.col, keys)])
    return placed.select(*rows.columns, F.floor(F.col("place__") / size).cast("long").alias("batch_id"))


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows: an evaluation's limit."""
    return rows.orderBy(*order).limit(most)


def drawn_batches(placed: DataFrame, n: int, batches: int, size: int, seed: int, place: str = "place") -> DataFrame:
    """batch_id, slot and the columns of placed (rows numbered from 0 to n - 1) for `batches` batches of `size` rows, each
    drawn from all rows.

    Within a batch no row is drawn twice, but if there are fewer rows than slots: then every slot draws for itself. A batch
    depends on the seed and its number only, so that a run can go on at any step; no rows give no batches.
    """
    spark = placed.sparkSession
    slots = spark.range(batches * size if n else 0).select((F.col("id") / size).cast("long").alias("batch_id"), (F.col("id") % size).alias("slot"))
    at = permuted("slot", n, f"{seed}:batch", "batch_id") if n >= size else draw(max(1, n), f"{seed}:batch", "batch_id", "slot")
    return slots.withColumn(place, at).join(placed, place).drop(place)
