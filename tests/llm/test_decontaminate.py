from __future__ import annotations

import random

from graphloom.llm import decontaminate
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes, words


def tiled(a: list, b: list, least: int) -> tuple[int, int]:
    """(words covered, tiles) of greedy string tiling, every match tried."""
    used_a, used_b, covered, n = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered, n
        used_a.update(range(i, i + k))
        used_b.update(range(j, j + k))
        covered, n = covered + k, n + 1


def brute(docs: list[tuple], items: list[tuple], coverage: float = 0.5) -> list[tuple]:
    out = []
    for d, t in docs:
        a = words(t)
        grams = {tuple(a[i : i + k]) for k in range(1, 6) for i in range(len(a) - k + 1)}
        for item, u in items:
            b = words(u)
            least = min(5, len(b))
            if b and any(tuple(b[j : j + least]) in grams for j in range(len(b) - least + 1)):
                covered, n = tiled(a, b, least)
                if covered / len(b) >= coverage:
                    out.append((d, item, covered, len(b), n, covered / len(b)))
    return sorted(out, key=repr)


def test_all_documents(spark, small):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(QUERIES["op5_leaks"](spark, small)) == brute(docs, items)


def test_reordered_passages(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice((3, 5, 12, 40))))) for i in range(25)] + [(90, None), (91, " "), (92, "one two three four five"), (92, "one two three four five")]
    docs = list(ODD[:5]) + [(6, "One two three FOUR five"), (8, "a b one two three four five c")]
    for i in range(60):
        w = items[rng.randrange(25)][1].split()
        parts = [w[k : k + 6] for k in range(0, len(w), 6)]
        rng.shuffle(parts)
        rest = [f"w{rng.randrange(200)}" for _ in range(30)]
        docs.append((100 + i, " ".join(rest[:9] + [x for p in parts for x in (*p, rng.choice(rest))] + rest[9:])))
    got = rows_of(decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id")))
    assert got == brute(docs, items) and len(got) > 30
    # Blocks of test items make no difference.
    assert rows_of(decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id"), block_bytes=300)) == got


def test_odd_rows(spark):
    docs, items = frame(spark, ODD), frame(spark, [(1, "the same text stands here the same"), (2, "one"), (None, "x y z"), (3, None)], "item_id")
    same_with_clashes(lambda d: decontaminate.leaks(d, items), docs)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} >= {(9, 1), (-5, 1), (4, 2), (5, 2), (6, 2)}
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {None, 1, 2, 3, 7, 8, 11, 12, (1 << 63) - 1}
