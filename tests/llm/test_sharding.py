from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm import sharding
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes


def check(docs: list[tuple], got: list, shards: int) -> None:
    want = [(d, len(raw := (t or "").encode()) + 1, zlib.crc32(raw), "bytes") for d, t in docs]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    slots, sizes = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in got:
        assert 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max((w[1] for w in want), default=0)
    mean = sum(sizes.values()) / shards
    assert all(abs(s - mean) <= most for s in sizes.values())


def test_all_documents(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op3_shards"](spark, medium).collect(), 16)


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    check(ODD, sharding.shard_by_bytes(docs).collect(), 16)
    same_with_clashes(sharding.shard_by_bytes, docs)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_one_group_holds_most_rows(spark):
    """Equal texts are dealt over shards and ranges; a small range target makes many ranges of them."""
    rows = [(i, "copy " * 50) for i in range(2000)] + [(5000 + i, f"text {i} " * (1 + i % 40)) for i in range(1000)]
    for shards, target in ((16, 4000), (7, 20_000), (1, 10_000)):
        check(rows, sharding.shard_by_bytes(frame(spark, rows), shards, target).collect(), shards)


def test_only_jvm_functions(spark, small):
    plan = QUERIES["op3_shards"](spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert rows_of(QUERIES["op3_shards"](spark, small).agg(F.count("*"))) == [(200,)]
