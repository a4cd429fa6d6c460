"""Row numbers and running sums over a whole table, without a window over the whole table.

Rows go to buckets that follow one another in the order; each bucket is numbered on its own and starts where the sums of
the buckets before it end. Only the buckets' sums, a bounded number of rows, meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import HASHES, order_hash

BUCKETS = 4096


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bucket(hash_: Column | str, buckets: int = BUCKETS) -> Column:
    """The bucket of an order hash: equal parts of its range, which hold about as many rows each."""
    return F.floor((F.col(hash_) if isinstance(hash_, str) else hash_) / F.lit(HASHES // buckets)).cast("int")


def running_sums(df: DataFrame, bucket: Column, order: list[Column], **sums: str) -> DataFrame:
    """df with a column for each of sums (new name=column): its total over the rows up to and with this one.

    bucket must not fall as the order goes on; rows that are equal in the order would be summed in any order.
    """
    rows = df.withColumn("bucket__", bucket)
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("bucket__").agg(*[F.sum(c).alias(f"{new}__") for new, c in sums.items()])
    heads = heads.select("bucket__", *[F.coalesce(F.sum(f"{new}__").over(before), F.lit(0)).alias(f"{new}__") for new in sums])
    inside = Window.partitionBy("bucket__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(heads, "bucket__").withColumns({new: F.sum(c).over(inside) + F.col(f"{new}__") for new, c in sums.items()})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, name: str, bucket: Column, order: list[Column]) -> DataFrame:
    """df with a row number from 0 in the order, which must decide between any two rows."""
    out = running_sums(df.withColumn("one__", F.lit(1).cast("long")), bucket, order, **{name: "one__"})
    return out.withColumn(name, F.col(name) - 1).select(*df.columns, name)


def ranked_within(df: DataFrame, keys: list[str], name: str, hash_: Column, order: list[Column], buckets: int = 1024) -> DataFrame:
    """df with a row number from 0 in each key's rows, in the order of a hash (and then of `order`).

    One key may hold most of all rows: each is numbered in parts of the hash's range.
    """
    rows = df.withColumn("hash__", hash_).withColumn("part__", hash_bucket("hash__", buckets))
    before = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*keys, "part__").agg(F.count("*").alias("n__")).select(*keys, "part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    inside = Window.partitionBy(*keys, "part__").orderBy("hash__", *order)
    out = rows.withColumn("rank__", F.row_number().over(inside) - 1).join(heads, [*keys, "part__"])
    return out.select(*df.columns, (F.col("before__") + F.col("rank__")).cast("long").alias(name))


#: Rounds of the network that makes a permutation.
ROUNDS = 6


def permuted(place: Column | str, n: int, seed: int | str, *key: Column | str) -> Column:
    """Where a permutation of 0 to n - 1 sends a place: each key has its own, which is never written down nor sorted.

    A number is taken as a place in a table of a by b cells; by turns the row and the column are shifted by a hash of the
    other, which can be undone, so no two places meet. The table has fewer than a cells too many: who lands there goes
    on until it is inside.
    """
    place = F.col(place) if isinstance(place, str) else place
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def network(x: Column) -> Column:
        row, column = (x / b).cast("long"), x % b
        start = F.struct(row.alias("row"), column.alias("column"))

        def turn(state: Column, k: Column) -> Column:
            by_row = k % 2 == 0
            shift = order_hash(seed, *key, k, F.when(by_row, state["column"]).otherwise(state["row"]))
            moved = F.when(by_row, (state["row"] + shift % a) % a).otherwise(state["row"])
            aside = F.when(by_row, state["column"]).otherwise((state["column"] + shift % b) % b)
            return F.struct(moved.alias("row"), aside.alias("column"))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, turn, lambda s: s["row"] * b + s["column"])

    # A walk among the cells too many, fewer than a, is over after as many steps; of 40 none is longer but by a miracle.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(a, 40))), F.lit(-1).cast("long"), lambda x, k: F.when((k > 1) & (x < n), x).otherwise(network(F.when(k == 1, place).otherwise(x))))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a permutation's walk did not end")).cast("long"))
