from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lm
from graphloom.llm.eliasfano import EliasFano, Trie, _quantised
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, words


def held(d: int | None) -> bool:
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


def brute(docs: list[tuple]) -> dict:
    """By doc_id and text: the columns, with scores from exact counts and no quantising."""
    end, unigrams, pairs, contexts = object(), Counter(), Counter(), Counter()
    for d, t in docs:
        if not held(d):
            line = [*words(t), end]
            unigrams.update(line)
            pairs.update(zip([None, *line], line))
            contexts.update([None, *line[:-1]])
    n, v = sum(unigrams.values()), len(unigrams)
    p = lambda w: (unigrams[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for d, t in docs:
        line = [*words(t), end]
        base = sum(math.log10(p(w)) for w in line)
        score = sum(math.log10((pairs[a, w] + lm.PRIOR * p(w)) / (contexts[a] + lm.PRIOR)) for a, w in zip([None, *line], line))
        out[d, t] = (held(d), len(line), sum(unigrams[w] > 0 for w in line), n, base, score)
    return out


def check(docs: list[tuple], got: list) -> None:
    want = {}
    for (d, _), x in brute(docs).items():
        want.setdefault(d, []).append(x)
    assert len(got) == len(docs)
    for r in got:
        row = tuple(r)[1:]
        assert any(row[:4] == x[:4] and row[4] == pytest.approx(x[4], rel=1e-9) and row[5] == pytest.approx(x[5], rel=0.02, abs=0.1) for x in want[r["doc_id"]]), (r, want[r["doc_id"]])


def test_all_documents(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_lm_score"](spark, medium).collect()
    check(docs, got)
    unseen = [r for r in got if r["held_out"]]
    # Better than the base model on documents that it has not learned from.
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_odd_rows_and_hot_words(spark):
    docs = frame(spark, ODD)
    check(ODD, lm.score(docs).collect())
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score(docs.filter("doc_id IS NULL")).first()["n_known"] == 0
    rows = [(i, "the " * 40 + f"w{i % 7} tail") for i in range(300)]
    check(rows, lm.score(frame(spark, rows), shard_bytes=2000).collect())


def test_scores_do_not_depend_on_shards(spark):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(1, 40))) for i in range(200)]
    few, many = (rows_of(lm.score(frame(spark, rows), shard_bytes=b)) for b in (1 << 30, 500))
    for x, y in zip(few, many, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=0.02)


@pytest.mark.parametrize("seed", range(30))
def test_elias_fano_round_trip_and_successors(seed):
    rng = np.random.default_rng(seed)
    n, top = int(rng.integers(1, 2000)), int(2 ** rng.integers(1, 63))
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    ef = EliasFano.encode(values)
    assert (ef.get(np.arange(n)) == values).all()
    wanted = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64), np.array([0, top], np.uint64)])
    assert (ef.successor(wanted) == np.searchsorted(values, wanted, "left")).all()


def test_trie_in_files(tmp_path):
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    sizes = rng.integers(0, 40, len(names))
    first = np.concatenate([[0], np.cumsum(sizes)])
    children = np.concatenate([np.sort(rng.choice(1 << 32, s, replace=False)) for s in sizes]).astype(np.uint32)
    unseen, seen = rng.normal(size=len(names)), rng.normal(size=len(children))
    Trie.write(str(tmp_path), names, unseen, first, children, seen)
    trie = Trie(str(tmp_path))
    assert (trie.node(names) == np.arange(len(names))).all()
    assert (trie.node(names + np.uint64(1))[~np.isin(names + np.uint64(1), names)] == -1).all()
    parent = np.repeat(np.arange(len(names)), sizes)
    code, stands_for = _quantised(seen)
    assert np.array_equal(trie.value(parent, children), stands_for[code])
    assert np.abs(stands_for[code] - seen).mean() < 0.02
    code, stands_for = _quantised(unseen)
    node = np.arange(len(names))
    absent = np.array([next(x for x in range(1 << 20) if x not in set(children[a:b].tolist())) for a, b in zip(first[:-1], first[1:])], np.uint32)
    assert np.array_equal(trie.value(node, absent), stands_for[code])
