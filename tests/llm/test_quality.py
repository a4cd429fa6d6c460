from __future__ import annotations

from graphloom.llm import quality
from graphloom.llm.queries import QUERIES

from .helpers import ODD, WORD, frame, rows_of, same_with_clashes


def counts(text: str | None) -> tuple:
    raw = (text or "").encode()
    found = WORD.findall(raw)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(found) - 2):
        windows.setdefault(tuple(found[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines, seen = 0, set()
    for line in raw.split(b"\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(len(w.decode()) for w in found), symbols, lines, len(covered), failed


def test_counts_of_all_documents(spark, medium):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op1_quality"](spark, medium).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == counts(docs[r["doc_id"]]), r
        assert not (r["base_failed"] and r["kept"])


def test_model_on_rows_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 4 != 1"), labels.filter("doc_id % 4 = 1").select("doc_id", "quality")
    rows = quality.judge(docs, train).join(test, "doc_id").filter("NOT base_failed").select("quality", "p_quality", "kept").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 20
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
    # Calibrated: the mean probability is near the share of good rows.
    assert abs(sum(r["p_quality"] for r in rows) / len(rows) - len(good) / len(rows)) < 0.05


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(9, 1), (10, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = rows_of(quality.judge(docs, labels))
    assert len(got) == len(ODD)
    assert sorted((tuple(r[:7]) for r in got), key=repr) == sorted(((d, *counts(t)) for d, t in ODD), key=repr)
    assert all(r[8] is None and r[7] == (not r[6]) for r in got)  # too few labels: the base rule decides
    same_with_clashes(lambda d: quality.judge(d, labels), docs)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(ODD)
    assert quality.passed(docs, labels).columns == docs.columns
    assert sorted(r[0] for r in quality.passed(docs.dropna(), labels).collect()) == sorted(r[0] for r in got if r[7] and r[0] is not None)
