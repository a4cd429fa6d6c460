from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neardup
from graphloom.llm.components import components
from graphloom.llm.queries import ORACLE_SQL, QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes, words


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs: list[tuple]) -> list[tuple]:
    ids = sorted({d for d, _ in docs if d is not None})
    sets = {d: shingles(t) for d, t in docs if d is not None}
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted(((d, len(shingles(t)), *((root(d), root(d) == d) if d is not None else (None, True))) for d, t in docs), key=repr)


def test_against_sql(spark, medium):
    got = rows_of(QUERIES["op7_near_duplicates"](spark, medium))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{medium}/documents.parquet'")
    assert got == sorted(duckdb.sql(ORACLE_SQL["op7_near_duplicates"]).fetchall(), key=repr)


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    assert rows_of(neardup.near_duplicates(docs)) == brute(ODD)
    same_with_clashes(neardup.near_duplicates, docs)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.deduplicated(docs).columns == docs.columns


def edited(rng: random.Random, base: list[str], n: int) -> str:
    line = list(base)
    for _ in range(n):
        line[rng.randrange(len(line))] = f"e{rng.randrange(10**9)}"
    return " ".join(line)


def test_near_the_threshold(spark):
    """Pairs on both sides of 0.75, chains of links, and short texts."""
    rng, rows, d = random.Random(5), [], 0
    for _ in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((6, 30, 100, 200)))]
        for n in range(rng.choice((2, 3, 5))):
            rows.append((d, edited(rng, base, rng.randrange(0, max(2, len(base) // 40) + 2 * n))))
            d += 1
    rng.shuffle(rows)
    assert rows_of(neardup.near_duplicates(frame(spark, rows))) == brute(rows)


def test_a_hot_group(spark):
    """A group beyond the size of a region: copies, near copies, and chains through them, in salted blocks."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, rng.choice((0, 1, 2, 3, 4)))) for i in range(900)]
    rows += [(2000 + i, edited(rng, base, 5 + i % 9)) for i in range(300)]
    assert rows_of(neardup.near_duplicates(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("size,part", [(300, None), (2300, None), (2300, 512)])
def test_sole_links_into_a_hot_group(spark, monkeypatch, size, part):
    """Documents whose only link, of 0.75 to 0.80, is to one member of a large group of near copies."""
    if part:
        monkeypatch.setattr(neardup, "PART", part)
    rng = random.Random(size)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, rng.choice((1, 2, 3)))) for i in range(size)]
    want = set()
    for k in range(40):
        member = rows[rng.randrange(size)][1].split()
        # Shingles of the member's own edits are kept, so that others of the group are less alike.
        n = next(n for n in range(1, 60) if similarity(" ".join(member[: 200 - n] + [f"z{k}x{i}" for i in range(n)]), " ".join(member)) < 0.80)
        rows.append((10**6 + k, " ".join(member[: 200 - n] + [f"z{k}x{i}" for i in range(n)])))
        want.add(10**6 + k)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    joined = sum(got[d] < 10**6 for d in want)
    assert len({got[i] for i in range(size)}) == 1 and joined >= 0.9 * len(want)


def test_no_sole_link_is_lost(spark):
    """As above, nearer to 0.75: of these hundred the forest alone misses one."""
    rng = random.Random(900)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, rng.choice((1, 2, 3)))) for i in range(900)]
    for k in range(100):
        member = rows[rng.randrange(900)][1].split()
        cut = lambda n, member=member, k=k: " ".join(member[: 200 - n] + [f"z{k}x{i}" for i in range(n)])
        n = next(n for n in range(1, 60) if similarity(cut(n), " ".join(member)) < 0.77) - 1
        rows.append((10**6 + k, cut(n)))
    got = {r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0}


@pytest.mark.parametrize("frequent", [0, 1])
def test_prefixes_alone_find_every_link(spark, monkeypatch, frequent):
    """Every pair at or over the threshold is among those that prefixes propose, whichever shingles count as frequent."""
    monkeypatch.setattr(neardup, "FREQUENT", 2 if frequent else 10**9)
    rng, rows = random.Random(11), []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 6, 30, 100)))]
        rows += [(len(rows) + n, edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for n in range(4)]
    docs = frame(spark, rows)
    classes = docs.selectExpr("doc_id", "doc_id AS component")
    got = {tuple(sorted(r)) for r in neardup._missed(docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text"), classes).collect()}
    linked = {(a, b) for a, x in rows for b, y in rows if a < b and 100 * len(shingles(x) & shingles(y)) >= 75 * len(shingles(x) | shingles(y))}
    assert linked and linked <= got


def test_unlinked_relatives_meet_in_few_pairs(spark):
    """Documents that share most shingles, though too few for a link, are not proposed in all pairs; a linked one among them is."""
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(150)], []
    for d in range(100):
        line = list(base)
        for at in (15, 45, 75, 105, 135):
            line[at + rng.randrange(10)] = f"e{d}x{at}"
        rows.append((d, " ".join(line)))
    rows.append((100, rows[40][1].replace("w2 ", "other ")))
    assert similarity(rows[100][1], rows[40][1]) >= 0.75 > similarity(rows[3][1], rows[40][1]) > 0.4
    docs = frame(spark, rows)
    missed = neardup._missed(docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text"), docs.selectExpr("doc_id", "doc_id AS component"))
    got = {tuple(sorted(r)) for r in missed.collect()}
    assert (40, 100) in got and len(got) < 200


def test_copies_of_one_component_do_not_meet_one_another(spark, monkeypatch):
    """Of a shingle that a large component and a few other documents hold, each pair of components meets in one cell, and the
    large one's rows are not repeated by its own size."""
    monkeypatch.setattr(neardup, "SIDE", 16)
    rows = [(7, 3, d, 100, 0 if d < 1000 else 1 if d < 1100 else d, 90) for d in range(1110)] + [(8, 3, d, 100, d, 90) for d in range(5)]
    table = spark.createDataFrame(rows, "shingle long, size int, doc_id long, n int, component long, rest int")
    a, b = (x.cache() for x in neardup._in_cells(table, table))
    # 1000 rows in 63 parts, 100 in 7 and ten in one: each row meets the parts of others only.
    assert a.count() == b.count() <= 1000 * 8 + 100 * 64 + 10 * 71 + 5
    met = a.join(b, ["shingle", "size", "a_part", "b_part"])
    pairs = met.filter("a_component <> b_component").groupBy("shingle", "a_doc_id", "b_doc_id").count()
    kinds = pairs.groupBy("shingle").agg(F.count("*"), F.max("count")).orderBy("shingle").collect()
    assert [tuple(r) for r in kinds] == [(7, 2 * (1000 * 110 + 100 * 10 + 45), 1), (8, 20, 1)]
    assert met.filter("shingle = 7 AND a_component = b_component AND a_component < 2").count() == 0


def similarity(x: str, y: str) -> float:
    p, q = shingles(x), shingles(y)
    return len(p & q) / len(p | q)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
