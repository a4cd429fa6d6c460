"""Nearest neighbours against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import forest
from graphloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows: list[tuple], k: int, asked) -> list[tuple]:
    """(query, rank, id, score) of all pairs, for rows of different ids."""
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if asked(q):
            near = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


def same(found, wanted) -> None:
    found = sorted(tuple(r) for r in found.collect())
    assert [r[:3] for r in found] == [r[:3] for r in sorted(wanted)]
    assert np.allclose([r[3] for r in found], [r[3] for r in sorted(wanted)], rtol=1e-12)


def recall(spark, folder: str) -> float:
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found: dict[int, dict[int, int]] = {}
    for r in QUERIES["op11_nearest"](spark, folder).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert r["score"] == pytest.approx(vectors[ids == r["query_id"]][0] @ vectors[ids == r["vec_id"]][0], abs=1e-12)
    asked = [i for i in ids if i % 20 == 0]
    assert set(found) == set(asked) and all(sorted(x) == list(range(1, 21)) for x in found.values())
    hits = 0
    for q in asked:
        score = vectors @ vectors[ids == q][0]
        true = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hits += len({*true} & {*found[q].values()})
    return hits / (20 * len(asked))


def test_recall_at_two_sizes(spark, medium):
    assert recall(spark, medium) >= 0.9
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_all_are_found_where_all_are_wanted(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(300, 6)) * draw.lognormal(size=(300, 1)))]
    found = forest.nearest(spark.createDataFrame(rows, SCHEMA), 7, F.col("vec_id") % 3 == 0, target=1.0)
    got = {(r[0], r[2]) for r in found.collect()}
    wanted = {(r[0], r[2]) for r in brute(rows, 7, lambda q: q % 3 == 0)}
    # The queries that set the limit are all of them, so nothing is missed.
    assert got == wanted


def test_ties_copies_and_odd_rows(spark):
    """Copies of one vector are a third of all rows; whole numbers tie; bad vectors take no part."""
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(40)] + [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(40, 100)]
    rows += [(200, None), (220, []), (240, [0.0, -0.0, 0.0]), (260, [1.0, None, 1.0]), (280, [1.0, float("nan"), 1.0]), (300, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (320, [1.0]), (-20, [2.0, 2.0, 2.0])]
    frame = spark.createDataFrame([*rows, rows[0], rows[0]], SCHEMA)
    wanted = brute([(i, v and [*v, 0.0, 0.0][:3] if v and len(v) < 3 else v) for i, v in rows], 20, lambda q: q % 20 == 0)
    same(forest.nearest(frame, 20, F.col("vec_id") % 20 == 0, target=1.0), wanted)
    clashing = frame.selectExpr("*", *[f"1 AS {c}" for c in ("id", "key", "rep", "query", "score", "rank", "low", "high", "block", "level", "near")])
    same(forest.nearest(clashing.repartition(7), 20, F.col("vec_id") % 20 == 0, target=1.0), wanted)


def test_hot_copies_over_many_blocks(spark, monkeypatch):
    """Rows of one string are divided over blocks by their id."""
    monkeypatch.setattr(forest, "BLOCK", 16)
    draw = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, float(x)]) for i, x in enumerate(draw.integers(0, 3, 150) * 1e-6)] + [(i, [float(x) for x in draw.normal(size=3)]) for i in range(150, 200)]
    same(forest.nearest(spark.createDataFrame(rows, SCHEMA), 5, F.col("vec_id") % 10 == 0, target=1.0), brute(rows, 5, lambda q: q % 10 == 0))


def test_few_rows_doubles_and_an_empty_table(spark):
    rows = [(20, [1.5, 0.0]), (40, [0.5, 1.0]), (41, [-1.0, -1.0])]
    same(forest.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), 20, F.col("vec_id") % 20 == 0), brute(rows, 20, lambda q: q % 20 == 0))
    assert forest.nearest(spark.createDataFrame([(20, [1.0])], SCHEMA)).collect() == []
    assert forest.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert forest.nearest(spark.createDataFrame([(20, [0.0])], SCHEMA)).columns == ["query_id", "rank", "vec_id", "score"]


def test_wanted_is_the_least_that_finds_enough():
    totals = {1: np.array([100, 50, 10, 1])}
    assert forest.wanted_candidates(totals, {1: [3, 2, 2, 1]}, 0.75) == 10
    assert forest.wanted_candidates(totals, {1: [3, 2, 2, 1]}, 1.0) == 50
    assert forest.wanted_candidates(totals, {1: [3, 3]}, 0.5) == 1
    assert forest.wanted_candidates(totals, {}, 0.9) == 1
