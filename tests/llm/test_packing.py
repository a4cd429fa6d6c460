from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import common, packing, tokens
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes


def check(docs: list[tuple], got: list, capacity: int = 4096) -> int:
    """Every rule of the packing but the number of sequences, which is returned."""
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            want.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_all_documents(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_packing"](spark, medium).collect()
    n, total = check(docs, got), sum(r["length"] for r in got)
    assert n == -(-total // 4096)


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    check(ODD, packing.pack(docs).collect())
    same_with_clashes(lambda d: packing.pack(d).drop("sequence_id", "offset"), docs)
    assert packing.pack(docs.limit(0)).count() == 0


def test_a_hot_length(spark):
    rows = [(i, "a b c d e") for i in range(3000)] + [(10_000 + i, "w " * (i % 900)) for i in range(900)]
    check(rows, packing.pack(frame(spark, rows)).collect())


@pytest.mark.parametrize("seed", range(60))
def test_patterns_against_the_least_number(seed):
    """Small bins, every packing tried."""
    rng = random.Random(seed)
    capacity = rng.choice((20, 50, 100))
    sizes = sorted((rng.randrange(1, rng.choice((capacity // 3, capacity // 2, capacity)) + 1) for _ in range(10)), reverse=True)

    def least(at: int, bins: list[int], best: int) -> int:
        if len(bins) >= best:
            return best
        if at == len(sizes):
            return len(bins)
        for i in {b: i for i, b in enumerate(bins) if b + sizes[at] <= capacity}.values():
            bins[i] += sizes[at]
            best = least(at + 1, bins, best)
            bins[i] -= sizes[at]
        return least(at + 1, [*bins, sizes[at]], best)

    found = packing.patterns({s: sizes.count(s) for s in set(sizes)}, capacity)
    assert sorted((x for items, n in found for x in items * n), reverse=True) == sizes
    assert all(sum(items) <= capacity for items, _ in found)
    assert sum(n for _, n in found) == least(0, [], 99)


def test_backtracking():
    """Filling one sequence after another as full as can be needs five."""
    lengths = [29, 28, 27, 26, 18, 15, 15, 12, 11, 9]
    assert sum(n for _, n in packing.best_fit(np.bincount(lengths, minlength=51), 50)) == 5
    found = packing.patterns({x: lengths.count(x) for x in lengths}, 50)
    assert sum(n for _, n in found) == 4 and sorted(x for items, n in found for x in items * n) == sorted(lengths)


@pytest.mark.parametrize("seed", range(30))
def test_no_bound_is_too_high(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 50, 1000))
    counts = np.bincount([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))], minlength=capacity + 1)
    n = sum(k for _, k in packing.best_fit(counts, capacity))
    assert -(-int((counts * np.arange(capacity + 1)).sum()) // capacity) <= packing.lower_bound(counts, capacity) <= n


def test_odd_tables_repeat(spark):
    assert rows_of(packing.pack(frame(spark, [(1, None), (1, None)]))) == [(1, 0, 0, 1, zlib.crc32(b"\1\0\0\0"), 0, 0), (1, 0, 0, 1, zlib.crc32(b"\1\0\0\0"), 0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_triplets_that_fill_all_sequences(seed):
    """60 lengths of which 20 sequences can be filled to the last place, where best fit needs 21 or more."""
    draw, lengths = random.Random(seed), []
    while len(lengths) < 60:
        a = draw.randint(380, 490)
        b = draw.randint(250, (1000 - a) * 6 // 10)
        lengths += [a, b, 1000 - a - b]
    found = packing.patterns(dict(Counter(lengths)), 1000)
    assert sum(n for _, n in found) == 20 and all(sum(items) == 1000 for items, _ in found)
    assert Counter(x for items, n in found for x in items * n) == Counter(lengths)


def test_fillings_leave_out_what_no_sum_fills():
    """Fillings that waste at most so much, against all subsets."""
    draw = random.Random(6)
    for _ in range(60):
        lengths = sorted((draw.randint(2, 30) for _ in range(8)), reverse=True)
        counts = np.bincount(lengths, minlength=41)
        for waste in (0, 2, 9):
            found = {tuple(sorted(f)) for _, f in packing.fillings(counts, 40, waste, [10**6])}
            fits = {tuple(sorted((lengths[0], *c))) for k in range(8) for c in combinations(lengths[1:], k) if 40 - waste <= lengths[0] + sum(c) <= 40}
            # Of what fits, one is always left: what dominates the others.
            assert found <= fits and bool(found) == bool(fits)


def test_tasks_return_freed_memory(monkeypatch):
    """After every GIVE_BACK_BYTES of text, not only after the last batch."""
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    monkeypatch.setattr(common, "GIVE_BACK_BYTES", 1000)
    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * 100] * 50)], ["text"])] * 2
    got = list(common.chunks(iter(batches), "text", 300))
    assert sum(b.num_rows for b in got) == 100 and max(b.num_rows for b in got) == 3 and 8 <= len(calls) <= 11
    calls.clear()
    assert list(common.given_back(iter(batches))) == batches and len(calls) == 1
