"""Benchmark decontamination by greedy string tiling.

Runs of `MIN_TILE` words that a document shares with a test item are seeds. Around the seeds, the longest matches of
words that are not yet marked are found by running Karp-Rabin (hashes of all runs of one length, longest length first)
and marked, again and again, so a passage whose sentences were put in another order is still covered. An item of which
at least `COVERAGE` is covered by tiles has leaked into the document.

The test set is taken in blocks of bounded size, each broadcast against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, text_bytes, without, written
from .words import U, Words

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 16_000_000

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _rolling(words: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(hash, place) of every run of `length` unmarked words, each hash made from the one before it."""
    top = pow(_STEP, length, 1 << 64)
    value, n = 0, 0
    for i, w in enumerate(words):
        if marked[i]:
            value, n = 0, 0
            continue
        value = (value * _STEP + w) & _MASK
        n += 1
        if n > length:
            value = (value - words[i - length] * top) & _MASK
        if n >= length:
            yield value, i - length + 1


def tiles(document: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """(document place, item place, length) of greedy tiles: the longest unmarked matches first, the leftmost of equals."""
    marked_a, marked_b = [False] * len(document), [False] * len(item)
    out: list[tuple[int, int, int]] = []
    length = _longest(document, item, marked_a, marked_b, least)
    while length >= least:
        places: dict[int, list[int]] = {}
        for value, j in _rolling(item, marked_b, length):
            places.setdefault(value, []).append(j)
        for value, i in list(_rolling(document, marked_a, length)):
            for j in places.get(value, ()):
                if document[i : i + length] == item[j : j + length] and not any(marked_a[i : i + length]) and not any(marked_b[j : j + length]):
                    marked_a[i : i + length] = [True] * length
                    marked_b[j : j + length] = [True] * length
                    out.append((i, j, length))
                    break
        length = _longest(document, item, marked_a, marked_b, least, length)
    return out


def _longest(a: list[int], b: list[int], marked_a: list[bool], marked_b: list[bool], least: int, below: int | None = None) -> int:
    """The greatest length with an unmarked match, by halving (a match of one length has matches of all lesser ones); 0 if under `least`."""
    low, high = least - 1, min(len(a), len(b)) if below is None else below
    while low < high:
        middle = (low + high + 1) // 2
        runs_b = {v for v, _ in _rolling(b, marked_b, middle)}
        if any(v in runs_b for v, _ in _rolling(a, marked_a, middle)):
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


class Seeds:
    """A block of test items: their words, and the sorted hashes of their seeds with the items that hold them."""

    def __init__(self, ids: list[int], texts: list[bytes], least: int = MIN_TILE):
        words = Words(texts)
        self.ids, self.least = ids, least
        self.words = [words.hashes[words.first[i] : words.first[i + 1]].tolist() for i in range(len(ids))]
        hashes, items = [], []
        #: Seeds of items shorter than a tile are the whole item; the lengths that occur, at most `least` of them.
        self.lengths = sorted({min(least, len(w)) for w in self.words if w})
        for k in self.lengths:
            grams, at = words.grams(k)
            owner = words.owners()[at]
            own = np.minimum(words.counts[owner], least) == k
            hashes.append(grams[own])
            items.append(owner[own])
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        order = np.argsort(h, kind="stable")
        self.hashes, self.items = h[order], (np.concatenate(items) if items else np.zeros(0, np.int64))[order]

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, words covered, words of the item, tiles) for every text and item that share a seed."""
        if not len(self.hashes):
            return []
        words = Words(texts)
        owners = words.owners()
        found: dict[tuple[int, int], list[int]] = {}
        for k in self.lengths:
            grams, at = words.grams(k)
            low, high = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
            for i in np.flatnonzero(low < high):
                text = int(owners[at[i]])
                for item in set(self.items[low[i] : high[i]].tolist()):
                    found.setdefault((text, item), []).append(int(at[i]))
        out = []
        for (text, item), seeds in sorted(found.items()):
            own, least = self.words[item], min(self.least, len(self.words[item]))
            # Tiles begin and end in runs of seeds: the stretches of the document that seeds cover.
            part: list[int] = []
            last = None
            for s in sorted(set(seeds)):
                begin = s if last is None else max(s, last)
                if last is not None and s > last:
                    part.append(-1 - len(part))  # no word: a match can't reach over it
                part += words.hashes[begin : s + least].tolist()
                last = s + least
            part = [w & _MASK for w in part]
            covered = tiles(part, own, least)
            out.append((text, self.ids[item], sum(n for _, _, n in covered), len(own), len(covered)))
        return out


def leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_covered, n_item_words, n_tiles, coverage): the test items that each document holds.

    Words are compared with A-Z lowered. An item under `least` words must occur whole; one without words, or null, is
    in nothing, and so is anything in an empty or null text. Repeated items are reported each, repeated documents once
    for each row. Extra columns are ignored; an empty table on either side gives no rows.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, n_covered long, n_item_words long, n_tiles long, coverage double"
    docs = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    items = narrow(benchmark, item_id="item_id", text="text").select("item_id", text_bytes().alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))

    def found_in(shared) -> DataFrame:
        def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*shared.value, least)
            for batch in chunks(batches, "text"):
                doc = batch.column("doc_id").to_pylist()
                rows = [(doc[t], *rest, rest[1] / rest[2]) for t, *rest in seeds.leaks(batch.column("text").to_pylist())]
                rows = [r for r in rows if r[-1] >= coverage]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 5 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "item_id", "n_covered", "n_item_words", "n_tiles", "coverage"])

        return docs.mapInArrow(detect, schema)

    parts = []
    for block in range(n_blocks):
        # A block has about block_bytes of text: the stated query set, against all documents.
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        parts.append(found_in(spark.sparkContext.broadcast(([r[0] for r in rows], [bytes(r[1]) for r in rows]))))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents into which no test item has leaked."""
    return without(documents, written(leaks(documents, benchmark, coverage).select("doc_id").distinct()))
