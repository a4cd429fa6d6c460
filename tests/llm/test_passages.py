"""Both operators on repeated passages, against every pair of words compared."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import chaining, passages, suffixes
from graphloom.llm.passages import without_passages
from graphloom.llm.queries import QUERIES

from .helpers import ODD, frame, rows_of, same_with_clashes, words

OPERATORS = {"chaining": chaining.fuzzy_passages, "suffixes": suffixes.repeated_passages}


def repeated(docs: list[tuple], n: int = 50) -> dict[int, set[int]]:
    """By doc_id the places of its words in runs of n equal words that a document of a lesser id holds, too."""
    first: dict[tuple, int] = {}
    texts = {d: words(t) for d, t in docs if d is not None}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out: dict[int, set[int]] = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                out[d].update(range(i, i + n))
    return out


def covered(got: list) -> dict[int, set[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for r in got:
        out[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
    return out


def check(docs: list[tuple], got: list, exact: bool) -> None:
    texts = {d: words(t) for d, t in docs}
    for r in got:
        assert r["source_doc_id"] < r["doc_id"]
        a = texts[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        assert len(a) == r["n_words"] >= 50
        if exact:
            assert a == texts[r["source_doc_id"]][r["source_start_word"] : r["source_start_word"] + r["n_words"]]
    want, have = repeated(docs), covered(got)
    if exact:
        assert have == want
    else:  # fuzzy passages go on where exact ones end
        assert all(want[d] <= have[d] for d in want)


def test_all_documents_chaining(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op8_fuzzy_passages"](spark, medium).collect(), False)


def test_all_documents_suffixes(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op9_repeated_passages"](spark, medium).collect(), True)


def planted(seed: int) -> list[tuple]:
    """Documents with shared passages of 40 to 400 words, some twice in one text, some in every text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(rng.choice((40, 49, 50, 51, 60, 120, 400)))] for _ in range(15)]
    common = [word() for _ in range(70)]
    docs = []
    for d in range(120):
        line = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            line += rng.choice(shared) + [word() for _ in range(rng.randrange(0, 30))]
        if d % 2:
            at = rng.randrange(len(line))
            line[at:at] = common
        docs.append((d, " ".join(line)))
    docs += [(500 + i, docs[i * 7][1]) for i in range(10)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("seed", (1, 2))
def test_planted_passages(spark, name, seed):
    docs = planted(seed)
    check(docs, OPERATORS[name](frame(spark, docs)).collect(), name == "suffixes")


def test_hot_suffixes(spark, monkeypatch):
    """Every prefix of over three suffixes is taken for a hot one."""
    monkeypatch.setattr(passages, "mean_share", lambda n, session: 3.0)
    docs = planted(3)
    check(docs, suffixes.repeated_passages(frame(spark, docs)).collect(), True)


def test_hot_suffixes_of_documents_that_repeat_themselves(spark, monkeypatch):
    """Each document says the passage many times over; all its places but the least document's have a source."""
    monkeypatch.setattr(passages, "mean_share", lambda n, session: 3.0)
    rng = random.Random(5)
    line = [f"w{rng.randrange(3000)}" for _ in range(30)]
    docs = [(d, " ".join([f"a{d}", *line * rng.randrange(4, 9), f"b{d}", *line * 4])) for d in range(12)]
    check(docs, suffixes.repeated_passages(frame(spark, docs)).collect(), True)


def test_fuzzy_passages(spark):
    """A changed, a lost or a new word here and there does not end a passage; other texts have none."""
    rng = random.Random(4)
    docs, want = [], {}
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        line, last = list(base), -20
        for at in range(12, 78):
            if at - last >= 16 and rng.random() < 0.2:
                last = at
                line[at] = rng.choice((f"x{at}", "", f"{line[at]} y{at}"))
        other = [f"v{rng.randrange(10**6)}" for _ in range(30)]
        docs += [(2 * i, " ".join([*base, *other[:10]])), (2 * i + 1, " ".join([*other[10:], *line]))]
        want[2 * i + 1] = (20, 2 * i)
    got = chaining.fuzzy_passages(frame(spark, docs)).collect()
    whole = 0
    for d, (start, source) in want.items():
        own = [r for r in got if r["doc_id"] == d]
        assert {r["source_doc_id"] for r in own} <= {source}
        assert all(r["start_word"] >= start - 1 and r["n_words"] <= 98 for r in own)
        whole += any(r["n_words"] >= 82 for r in own)
    assert whole >= 36 and {r["doc_id"] for r in got} <= set(want)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = frame(spark, ODD)
    got = OPERATORS[name](docs).collect()
    # 10 is an exact copy of 9, which is one of -5 but for its case.
    assert [tuple(r)[1:] for r in got if r["doc_id"] == 10] == [(0, 150, 9, 0, 150)]
    assert {r["doc_id"] for r in got} == {9, 10} and {r["source_doc_id"] for r in got if r["doc_id"] == 9} == {-5}
    check([(d, t) for d, t in ODD if d is not None], got, name == "suffixes")
    same_with_clashes(OPERATORS[name], docs)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        OPERATORS[name](docs, 30)


def test_cutting(spark):
    docs = spark.createDataFrame([(1, "a b  c d\ne f", 12, "x"), (2, "a b c", 5, None), (3, "", 0, "x"), (4, None, None, "x")], "doc_id long, text string, n_chars long, lang string")
    cuts = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 0, 3)], "doc_id long, start_word long, n_words long")
    got = without_passages(docs, cuts)
    assert got.columns == docs.columns
    assert rows_of(got) == [(1, "a e f", 5, "x"), (3, "", 0, "x"), (4, None, None, "x")]
    for without in (chaining.without_repeats, suffixes.without_repeats):
        assert rows_of(without(docs)) == rows_of(docs)


def test_a_least_document_with_the_seeds_but_not_the_passage(spark):
    """0 quotes every part of the passage in another order, 1 holds it, and 2 and 3 hold edits of it."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(160)]
    # Every seed of the base stands in one part with a whole window about it; a part is no passage.
    parts = [base[max(i, 0) : i + 45] for i in range(-25, 160, 10)]
    quotes = [w for p in reversed(parts) for w in [*p, *(word() for _ in range(30))]]
    edit = lambda k: [f"{k}x{i}" if i % 40 == 9 + k else w for i, w in enumerate(base)]
    docs = [(0, " ".join(quotes)), (1, " ".join(base)), (2, " ".join([*edit(1), word()])), (3, " ".join([word(), *edit(2)]))]
    have = covered(chaining.fuzzy_passages(frame(spark, docs)).collect())
    assert not have[0] and not have[1]
    assert len(have[2]) >= 150 and len(have[3]) >= 150


def test_a_far_long_segment_does_not_hide_a_near_one():
    found = np.array([[0, 500, 0, 500], [700, 720, 700, 720], [740, 760, 741, 761], [780, 800, 782, 802]])
    assert chaining.chain(found) == [[0], [1, 2, 3]]


def test_exact_passage_before_a_fuzzy_one(spark):
    """The fuzzy one's words shift by one at each edit, so each of its segments is too short alone."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    exact, fuzzy = some(500), some(160)
    edited = [w for i, w in enumerate(fuzzy) if i % 27 not in (24, 25, 26)]
    docs = [(0, " ".join([*exact, *some(120), *fuzzy])), (1, " ".join([*exact, *some(120), *edited]))]
    have = covered(chaining.fuzzy_passages(frame(spark, docs)).collect())
    assert set(range(500)) <= have[1] and len(have[1] & set(range(620, 620 + len(edited)))) >= 110


def edited(draw: random.Random, passage: list[str], share: float) -> list[str]:
    """The passage with a share of its words replaced, dropped or followed by another."""
    out = []
    for w in passage:
        kind = draw.random()
        out += [f"new{draw.randrange(10**6)}"] if kind < share / 2 else [] if kind < 0.75 * share else [w, f"new{draw.randrange(10**6)}"] if kind < share else [w]
    return out


def with_edits(draw: random.Random, n: int, n_passages: int, copies: int, share: float) -> tuple[list[tuple[int, str]], dict[int, tuple[int, int]]]:
    """Documents of which some hold edits of common passages, and where these lie."""
    texts = [[f"w{draw.randrange(5000)}" for _ in range(draw.randrange(40, 200))] for _ in range(n)]
    places, free = {}, list(range(n))
    draw.shuffle(free)
    for _ in range(n_passages):
        passage = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(70, 130))]
        for d in (free.pop() for _ in range(copies)):
            own, at = edited(draw, passage, share), draw.randrange(len(texts[d]))
            texts[d][at:at] = own
            places[d] = (at, at + len(own))
    return [(d, " ".join(t)) for d, t in enumerate(texts)], places


def test_hot_seeds_give_the_same_passages_however_they_are_dealt(spark, monkeypatch):
    """40 edits of one passage in 101 documents, without runs of 50 equal words, whose sources depend on how suffixes are
    dealt: without hot seeds, with them, and with many cells of each."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage, docs = [word() for _ in range(80)], []
    for d in range(101):
        own = [word() if k % 13 == 5 else w for k, w in enumerate(passage)] if d % 5 < 2 else []
        docs.append((d, " ".join([*(word() for _ in range(30)), *own, *(word() for _ in range(30))])))
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for sample, n in ((0.0, 4), (1.0, 4), (1.0, 60)):
            monkeypatch.setattr(chaining, "SAMPLE", sample)
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows_of(chaining.fuzzy_passages(frame(spark, docs))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    edits = {d for d in range(1, 101) if d % 5 < 2}
    assert {r[0] for r in found[0]} <= edits and len({r[0] for r in found[0]}) >= 0.9 * len(edits)


@pytest.mark.parametrize("n", [300, 1500])
def test_recall_of_edited_passages(spark, n):
    """Of copies with one word in 50 changed in each, 0.9 are found at either size, over most of their words. Heavier edits are
    found less often (README has figures)."""
    docs, places = with_edits(random.Random(n), n, n // 30, 5, 0.02)
    have, hits = covered(chaining.fuzzy_passages(frame(spark, docs)).collect()), 0
    for d, span in places.items():
        hits += len(have[d] & {*range(*span)}) >= 0.7 * (span[1] - span[0])
    # The first of each passage's documents has no source.
    assert hits >= 0.9 * (len(places) - n // 30)
