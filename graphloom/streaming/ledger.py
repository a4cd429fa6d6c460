"""Resumable work on Structured Streaming: a ledger of the last record of every key, event windows, first rows.

Offsets and state live in the query's checkpoint, which takes the place of hand-kept high-water marks. The ledger is a
log of changes: a record is added when it is later, by its file's name and its line, than what the key's state holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.predicates import is_terminal
from ..sources.exports import RECORD, checkpoint_lines

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOGGED = f"{RECORD}, file string, line long, arrived timestamp"


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Checkpoint lines as files are added to a folder, each with its file and line; lines that aren't records are dropped."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return checkpoint_lines(files)


class LastRecord(StatefulProcessor):
    """Passes on a key's last record if it is later than the one held. A key whose records stopped to come is forgotten once
    the watermark has passed the last of them; then any record of it is passed on, and the reader's order decides."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "file string, line long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        last = max(rows, key=lambda r: (r["file"], r["line"]))
        before = tuple(self.held.get()) if self.held.exists() else None
        if before is None or before < (last["file"], last["line"]):
            self.held.update((last["file"], last["line"]))
            yield last
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(last["arrived"].timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow(records: DataFrame, ledger: str, checkpoint: str, keep: str = "30 days") -> StreamingQuery:
    """Add each record to the ledger that is the last of its wid so far.

    State is one (file, line) a wid, held for `keep` after its last record came; arrival is the event time, so that no
    record is ever late. A batch is written to a folder of its own number, so one that is run again after a failure
    replaces itself. The ledger is never read here.
    """
    spark = records.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    timed = records.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", keep)
    last = timed.groupBy("wid").transformWithState(LastRecord(), _LOGGED, outputMode="Update", timeMode="EventTime")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)  # the store that keyed state of this kind needs; a query keeps the one it starts with
    try:
        return last.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def logged(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's last record of every wid, whatever its status; None if there is no ledger."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("basePath", ledger).parquet(f"{ledger}/batch=*").drop("batch", "arrived")
    except AnalysisException:
        return None
    last = rows.groupBy("wid").agg(F.max_by(F.struct(*rows.columns), F.struct("file", "line")).alias("last"))
    return last.select("last.*")


def known(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The wids' last records that need no further try."""
    rows = logged(spark, ledger)
    return None if rows is None else rows.filter(is_terminal("_fetch_status", "url", "brief"))


def windowed(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """(start, end, event_type, n, total): events in sliding windows of their time; rows later than `late` are dropped.
    Times without a zone are read in the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def first_per_key(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: the streaming form of an ordered distinct."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
