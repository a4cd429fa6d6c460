"""Helpers that the operators share: written tables, column narrowing and streams of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import shared_folder

#: Bytes of text that a task turns into arrays at one time.
CHUNK_BYTES = 500_000
#: Bytes of text after which a task returns freed memory to the system.
GIVE_BACK_BYTES = 4_000_000
#: Bytes of a batch that Spark sends to Python; a task holds a few of them.
BATCH_BYTES = 4_000_000
#: Bits a counted id of a bitmap of ids, and its most bits: 16 MB. Beyond half as many ids, joins take its place.
BITS_AN_ID = 16
MOST_BITS = 1 << 27


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so that other columns cannot clash with ours.

    Every operator begins with this, so it is also where the session is told to send texts to Python in small batches.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(*[df[name].alias(own) for own, name in columns.items()])


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Return freed memory to the system: Spark keeps its Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what a task has freed goes back to the system after the last, as at the end of chunks and runs."""
    yield from batches
    _give_back()


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in `column`; one long value is a slice of its own."""
    seen = 0
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
                if seen > GIVE_BACK_BYTES:
                    _give_back()
                    seen = 0
            held, seen = held + size, seen + size
        if start < batch.num_rows:
            yield batch.slice(start)
    _give_back()


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal key, from batches sorted by key. The open last run is carried on."""
    held: list[pa.RecordBatch] = []

    def last_key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in key)

    for batch in batches:
        if not batch.num_rows:
            continue
        tail = last_key(batch)
        # The first row of the run that is still open at the end of this batch.
        low, high = 0, batch.num_rows - 1
        while low < high:
            middle = (low + high) // 2
            if tuple(batch.column(k)[middle].as_py() for k in key) == tail:
                high = middle
            else:
                low = middle + 1
        if low == 0 and held and last_key(held[-1]) == tail:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, low)] if low else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held)
    del held
    _give_back()


class Ids:
    """A set of ids as a bitmap, sized by their number, which tasks get by broadcast: it holds every id, and maybe others.

    It keeps rows out of a shuffle that a join would drop, or would not change; the join stays the judge of the rest.
    Where there are more ids than the greatest bitmap has room for, the join alone picks the rows.
    """

    def __init__(self, ids: DataFrame, column: str = "doc_id"):
        self.ids, self.column, self.shared = ids.select(F.col(column).alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), column, None
        n = self.ids.count()
        if n > MOST_BITS // 2:
            return
        # An odd number of bits, so that ids with a stride are dealt evenly.
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_AN_ID * n - 1).bit_length() if n else 0)) - 1
        bits = self.ids.select(F.pmod("doc_id", F.lit(self.bits)).alias("bit"))
        bits = bits.selectExpr("CAST(bit DIV 64 AS INT) AS word", "shiftleft(1L, CAST(bit % 64 AS INT)) AS bits")
        rows = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
        words = np.zeros(self.bits // 64 + 1, np.int64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def rows(self, df: DataFrame, there: bool = True, column: str = "doc_id") -> DataFrame:
        """The rows of df whose id may be in the set; with there=False the others, whose id is not in it or null."""
        return self.mapped(df, None, df.schema, there, column)

    def mapped(self, df: DataFrame, function, schema, there: bool = True, column: str = "doc_id") -> DataFrame:
        """function, if any, over rows(...), in the same Python worker."""
        if self.shared is None:
            own = f"id_{uuid.uuid4().hex}"  # no column of df
            picked = df.join(self.ids.withColumnRenamed("doc_id", own), F.col(column) == F.col(own), "left_semi" if there else "left_anti")
            return picked.mapInArrow(function, schema) if function else picked
        shared, bits = self.shared, self.bits

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(column)
                bit = np.mod(own.fill_null(0).to_numpy(zero_copy_only=False), bits)
                has = ((shared.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                yield batch.filter(pa.array((has & own.is_valid().to_numpy(zero_copy_only=False)) == there))

        return df.mapInArrow((lambda batches: function(picked(batches))) if function else picked, schema)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose doc_id is not in gone (doc_id). Only those that may go are shuffled."""
    ids = Ids(gone)
    return ids.rows(documents, False).unionByName(ids.rows(documents).join(gone.distinct(), "doc_id", "left_anti").select(*documents.columns))


def hot_keys(rows: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """(key, salts) of the keys with more rows than `share`, half of a partition's mean where it is not given, and how
    many such shares each has: at most two keys a partition, small enough to broadcast. rows may be a sample."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    if share is None:
        counts = written(counts)
        share = mean_share(counts.agg(F.sum("n")).first()[0], rows.sparkSession)
    return written(counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("salts")))


def mean_share(n_rows: int | None, spark: SparkSession) -> float:
    """Half of a partition's mean share of n_rows rows."""
    return max(4.0, (n_rows or 0) / (2 * partitions(spark)))


def dealt(rows: DataFrame, key: str, hot: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by (key, salt) and sorted by these and `order`. The salt of a hot key depends on doc_id and is 1 or more;
    that of any other key is 0."""
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")) + 1, F.lit(0)).cast("int")
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("salts")
    return marked.repartition(partitions(rows.sparkSession), key, "salt").sortWithinPartitions(key, "salt", *order)
