"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of text, hash of doc_id, doc_id): equal texts stand together, and a hot group can still be
split among its documents. Keys are drawn with a chance in proportion to size; quantiles of the draw are range
boundaries. The bytes of each range are then counted exactly and a range that got too much is divided by a further draw
in it. Ranges are small enough for a window each, and their running totals give every record its exact place in the
whole order: shard k takes the k-th of equal parts of the bytes, so shards differ by less than one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, written

SHARDS = 16
RANGE_BYTES = 8_000_000
MOST_RANGES = 4096
DRAWS_PER_RANGE = 48
OVERFULL = 3.0
ROUNDS = 3

_KEY = ("text_key", "doc_key")


def _drawn(records: DataFrame, every_bytes: Column | float, salt: int) -> DataFrame:
    """A draw in which a record has the chance size / every_bytes. The draw depends on the key only."""
    chance = F.pmod(F.xxhash64(*_KEY, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return records.filter(chance < F.col("size") / every_bytes)


def _split_points(drawn: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a bounded draw: at most `ranges` - 1 keys."""
    part = F.ntile(ranges).over(Window.orderBy(*_KEY))
    rows = drawn.select(*_KEY, part.alias("part")).groupBy("part").agg(F.min(F.struct(*_KEY)).alias("low")).filter("part > 1").select("low.*").distinct().collect()
    return sorted((r[0], r[1]) for r in rows)


def _range_of(points: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below a record's key, found in two steps of about the root of their number."""
    if not points:
        return F.lit(0)
    key = F.struct(*[F.col(c) for c in _KEY])
    step = max(1, int(len(points) ** 0.5))
    literal = lambda rows: "array(" + ", ".join(f"named_struct('text_key', {_long(a)}, 'doc_key', {_long(b)})" for a, b in rows) + ")"
    blocks = [points[i : i + step] for i in range(0, len(points), step)]
    upper = F.size(F.filter(F.expr(literal([b[0] for b in blocks])), lambda p: p <= key))
    lower = F.element_at(F.expr("array(" + ", ".join(literal(b) for b in blocks) + ")"), F.greatest(upper, F.lit(1)))
    return F.when(upper == 0, F.lit(0)).otherwise((upper - 1) * step + F.size(F.filter(lower, lambda p: p <= key)))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def shard_by_bytes(documents: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus 1. Slots count from 0 in each shard without gaps, in key order.
    Repeated rows each get a slot. A null doc_id is ordered first among equal texts. Extra columns are ignored. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = written(
        narrow(documents, doc_id="doc_id", text="text").select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.xxhash64("doc_id").alias("doc_key")
        )
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(2 * shards, total // range_bytes)))
    target = max(1.0, total / ranges)
    points = _split_points(_drawn(records, max(1.0, target / DRAWS_PER_RANGE), 0), ranges)
    for turn in range(1, ROUNDS + 1):
        sized = records.withColumn("range", _range_of(points)).groupBy("range").agg(F.sum("size").alias("bytes"))
        overfull = {r["range"]: r["bytes"] for r in sized.filter(F.col("bytes") > OVERFULL * target).collect()}  # at most `ranges` rows
        if not overfull:
            break
        inside = _drawn(records.withColumn("range", _range_of(points)).filter(F.col("range").isin(list(overfull))), max(1.0, target / DRAWS_PER_RANGE), turn)
        more = int(sum(overfull.values()) // target)
        points = sorted({*points, *_split_points(inside, 2 * max(1, more))})

    ranged = records.withColumn("range", _range_of(points))
    # One row a range: a bounded broadcast, and a bounded window.
    heads = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy(*_KEY, "doc_id", "size", "text_crc32")
    placed = (
        ranged.withColumn("own_row", F.row_number().over(inside) - 1)
        .withColumn("own_bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(heads), "range")
        .withColumn("row", F.col("rows_before") + F.col("own_row"))
        .withColumn("byte", F.col("bytes_before") + F.col("own_bytes"))
    )
    # The shard is that of the record's middle: floor(shards * middle / total), in whole numbers.
    middle = F.col("byte") * 2 + F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2.0 * max(1, total)) * shards), F.lit(shards - 1)).cast("int"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "row"))
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
