"""Spelling variants against comparing all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from graphloom.llm import spelling
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows: list[tuple], least: int, times: int, dropped: int | None) -> dict[str, int]:
    n: Counter[str] = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if dropped and doc_id is not None and h % dropped == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= times}


def plain_forms(n: dict[str, int]) -> set[tuple]:
    # Words at distance one share what is left without one letter, or one is what is left of the other.
    by: dict[str, set[str]] = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    of = {w: {b for i in range(len(w)) for b in by[w[:i] + w[i + 1 :]] if b != w and near(w, b)} | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in n} | by.get(w, set()) for w in n}
    best = {w: min(of[w], key=lambda b: (-n[b], b), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(of[w]), n[form[w]] if form[w] else None))
    return out


def found(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_over_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(QUERIES["op13_spellings"](spark, small)) == plain_forms(plain_counts(rows, 5, 3, 97))


@pytest.mark.parametrize("most", [50_000, 6, 1])
def test_pairs_however_the_trie_is_cut(spark, monkeypatch, most):
    """Repeated letters, one hot prefix and one hot ending, words of one letter; each pair once in both orders."""
    monkeypatch.setattr(spelling, "MOST", most)
    draw = random.Random(most)
    words = {"".join(draw.choice("ab" if draw.random() < 0.8 else "abcé") for _ in range(draw.choice([1, 2, 3, 5, 5, 6, 7, 9]))) for _ in range(250)}
    words |= {a + "".join(draw.choice("abc") for _ in range(draw.choice([2, 3]))) + b for a, b in (("hotstart", ""), ("", "hotending")) for _ in range(40)}
    n = {w: draw.randint(1, 50) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.pairs(df)) == sorted(((a, n[a], b, n[b]) for a in n for b in n if a != b and near(a, b)), key=repr)
    assert found(spelling.forms(df)) == plain_forms(n)


def test_long_ways_of_forms(spark):
    """A chain of forms, each twice as frequent as the one before, ends at one root."""
    word = "abcdefghijklmnop"
    n = {word[:k]: 1 << (40 - 2 * k) for k in range(5, 17)}
    assert found(spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_forms(n)
    with pytest.raises(ValueError):
        spelling.forms(spark.createDataFrame([("abc", 1)], "word string, n long"), times=1)


def test_odd_rows(spark):
    texts = ["Straße straße STRASSE naïve Naive naive", "x×y÷z ÀÉÿ àéÿ", "y" * 3000 + " " + "y" * 3001, "don't e-mail漢字word", "ſharp ǅ K"]
    rows = [*ODD, *[(20 + i, t) for i, t in enumerate(texts * 3)]]
    df = frame(spark, rows)
    for dropped in (None, 97, 3):
        counts = plain_counts(rows, 2, 2, dropped)
        assert dict(map(tuple, spelling.counted(df, 2, 2, dropped).collect())) == counts
        assert found(spelling.forms(spelling.counted(df, 2, 2, dropped))) == plain_forms(counts)
    same_with_clashes(lambda x: spelling.forms(spelling.counted(x, 2, 2)), df)
    assert spelling.forms(spelling.counted(df.limit(0))).collect() == []
