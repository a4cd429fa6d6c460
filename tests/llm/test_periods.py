"""Periodic runs against a plain search."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import periods
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, same_with_clashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by going along every period."""
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            stretch = words[i : j + p]
            if len(stretch) >= max(6, 4 * p) and not any(stretch[d:] == stretch[:-d] for d in range(1, p)):
                out.append((i, len(stretch), p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def wanted(doc_id: int | None, text: str | None, repeated: bool = True) -> tuple:
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if repeated and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=5), min_size=1, max_size=3))
def test_runs_of_joined_repeats(texts):
    lines = sorted(([x for part, times in text for x in part * times] for text in texts), key=len, reverse=True)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    found = periods.runs_of(np.array([x for line in lines for x in line], np.uint64), first)
    assert sorted((s, e - s, p) for s, e, p in found) == sorted((s + int(at), n, p) for at, line in zip(first, lines) for s, n, p in plain(line))


def test_one_word_many_times_takes_little_work():
    assert periods.runs_of(np.zeros(100_000, np.uint64), np.array([0, 100_000])) == [(0, 100_000, 1)]
    words = np.tile(np.arange(1500, dtype=np.uint64), 60)
    assert periods.runs_of(words, np.array([0, len(words)])) == [(0, len(words), 1500)]


def test_query_over_whole_table(spark, small):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    assert found == {wanted(i, t) for i, t in table.items()}


def test_odd_rows(spark):
    rows = [*ODD, (40, "a b " * 5000), (50, "x " * 5), (60, "x " * 6), (70, "x\ty\nx\x0by x y x y z z z z z z"), (80, "été fini " * 8)]
    df = frame(spark, rows)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for repeated in (False, True):
        found = periods.periodic_runs(df, repeated).select(*names).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(repr(wanted(i, t, repeated)) for i, t in rows)
    same_with_clashes(periods.periodic_runs, df)
    assert periods.periodic_runs(df.limit(0)).collect() == []


def test_collapsed_texts(spark):
    rows = [(1, "go  on " + "ha ha ha ha ha ha ha then\nstop"), (2, "as\tit  is"), (3, None), (4, "a b " * 4 + "a b c")]
    assert {r["doc_id"]: r["text"] for r in periods.collapsed(frame(spark, rows)).collect()} == {1: "go on ha then stop", 2: "as\tit  is", 3: None, 4: "a b c"}


def test_run_is_found_once():
    # The fourth grid point of a stretch from word 10 lies beyond the run, so the run does not cover it.
    line = [0, 0, 0] + [1, 0, 0, 0, 0] * 4 + [0, 0, 0]
    found = periods.runs_of(np.array(line, np.uint64), np.array([0, len(line)]))
    assert sorted(found) == [(0, 23, 5), (19, 26, 1)]
