from __future__ import annotations

import re
import tempfile

import corpus_pipeline
from graphloom.llm import common, decontaminate, neardup
from graphloom.llm.common import written
from pyspark.sql import functions as F

from .helpers import words
from .test_passages import repeated


def test_stages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    folder, kept = tempfile.mkdtemp(prefix="stages-", dir="/tmp"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, medium).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept[name] = docs
        if k < 4:
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    n = [kept[x].count() for x in names[:4]]
    assert 1000 > n[0] > n[1] >= n[2] > n[3] > 600
    # Nothing is left of what each stage removes.
    assert neardup.near_duplicates(kept["near dedup"]).filter("NOT kept").count() == 0
    left = [tuple(r) for r in kept["substring dedup"].select("doc_id", "text").collect()]
    assert sum(map(len, repeated(left).values())) <= 0.001 * sum(len(words(t)) for _, t in left)
    benchmark = spark.read.parquet(f"{medium}/benchmark.parquet")
    assert decontaminate.leaks(kept["decontamination"], benchmark).count() == 0
    packed = kept["best-fit packing"]
    assert packed.select("doc_id").distinct().count() == n[3]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    # run() does the same.
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, medium).select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))
    assert all(re.fullmatch(r"[a-z\- ]+", x) for x in names)


def test_odd_rows_extra_columns_and_an_empty_table(spark, small):
    """Nulls, empty and long texts, repeated rows and columns with clashing names go through all stages."""
    from .helpers import ODD, frame, with_clashes

    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()
    long = " ".join(r["text"] for r in real[:40])
    rows = [*ODD, *[(1000 + r["doc_id"], r["text"]) for r in real], (5000, real[0]["text"]), (1000 + real[1]["doc_id"], real[1]["text"]), (None, real[2]["text"]), (6000, long)]
    docs = with_clashes(frame(spark, rows)).withColumn("n_chars", F.length("text")).withColumn("__id", F.lit(1))
    for table, whole in ((docs, True), (docs.limit(0), False)):
        kept = [table.count()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = written(stage(spark, table, small))
            assert table.columns == columns, name
            kept.append(table.count())
        assert kept == sorted(kept, reverse=True) and (kept[-1] > 10) == whole
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, small)
        packed = [tuple(r) for r in pieces.select("doc_id", "start", "length", "sequence_id", "offset").collect()]
        assert len({(s, o) for _, _, _, s, o in packed}) == len(packed) >= kept[-1]
        if whole:
            ids = {d for d, *_ in packed}
            assert None in ids and not ids & {1, 2, 3, 4}  # too short for the rules; a row without an id is kept by its text
            assert not (1000 + real[0]["doc_id"] in ids and 5000 in ids)


def test_ids_by_bitmap_and_by_join(spark, monkeypatch):
    """Where there are too many ids for a bitmap a join picks the rows, also beside columns of any name."""
    docs = spark.createDataFrame([(i if i else None, "x", i) for i in range(50)], "doc_id long, text string, __id int")
    gone = spark.createDataFrame([(i,) for i in (3, 7, 7, 49, 100)] + [(None,)], "doc_id long")
    wanted = sorted(i for i in range(50) if i not in (3, 7, 49))
    for bits in (common.MOST_BITS, 4):
        monkeypatch.setattr(common, "MOST_BITS", bits)
        assert sorted(r["__id"] for r in common.without(docs, gone).collect()) == wanted
