"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period q, at least max(LEAST_WORDS, LEAST_PERIODS * q) words long, that no
neighbouring word extends. For every word length p of a period, words at the grid points jp and (j + 1)p are compared: a
run of period p holds LEAST_PERIODS grid points, so as many less one of these comparisons in a row come out equal. What
survives is probed between its grid points, then extended by comparing growing chunks of words with those p further on.
Grid points within a run that has been found, of p or of a divisor of p, are skipped. All this costs n/p comparisons for
each p, n log n in sum, and is done for a whole batch of texts at once, the longest first, so that a period is tried only
on texts that can hold it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, text_bytes
from .words import Words

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that an extension compares at first; each further chunk is twice as long, up to the most.
CHUNK, MOST_CHUNK = 64, 1 << 16
#: Words that are joined at one time.
PIECE = 1 << 16

RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def _alike(p: np.ndarray, q: np.ndarray) -> int:
    """How many leading words are equal, chunk by chunk."""
    at, step, n = 0, CHUNK, len(p)
    while at < n:
        differ = p[at : at + step] != q[at : at + step]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = at + step, min(2 * step, MOST_CHUNK)
    return n


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return [*out, n] if n > 1 else out


class _Found:
    """Runs found so far by period, as starts and ends in the order of their starts. Runs of one period don't hold one another."""

    def __init__(self):
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def put(self, period: int, start: int, end: int) -> None:
        self.by_period.setdefault(period, []).append((start, end))

    def covered(self, period: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which stretches [low, high] lie within a run of the period or of a divisor of it."""
        out = np.zeros(len(low), bool)
        for d in self.by_period if len(self.by_period) < 64 else _divisors(period):
            if period % d == 0 and d in self.by_period:
                runs = np.array(self.by_period[d])
                at = np.searchsorted(runs[:, 0], low, "right") - 1
                out |= (at >= 0) & (runs[at, 1] > high)
        return out


def _divisors(n: int) -> list[int]:
    small = [d for d in range(1, int(n**0.5) + 1) if n % d == 0]
    return [*small, *(n // d for d in small)]


def runs_of(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in texts that follow one another: words as hashes, first as each text's first word.

    The longest text must come first. Runs are found by period, and by start within each.
    """
    n = len(words)
    sizes = np.diff(first)
    owner_end = np.repeat(first[1:], sizes)
    owner_start = np.repeat(first[:-1], sizes)
    found, out = _Found(), []
    reach = LEAST_PERIODS - 1
    for p in range(1, int(sizes.max(initial=0)) // LEAST_PERIODS + 1):
        # Texts that can hold a run of this period come first.
        stop = int(first[np.searchsorted(-sizes, -LEAST_PERIODS * p, "right")])
        grid = words[:stop:p]
        equal = grid[1:] == grid[:-1]
        if len(equal) < reach:
            continue
        row = equal[reach - 1 :].copy()
        for k in range(reach - 1):
            row &= equal[k : len(equal) - reach + 1 + k]
        low = np.flatnonzero(row) * p
        if not len(low):
            continue
        high = low + reach * p
        low, high = (x[owner_end[low] > high] for x in (low, high))
        # Between the grid points, too, every word equals the one a period on.
        for part in sorted({p // 5, p // 3, p // 2, p - 1} - {0}):
            for k in range(reach - 1):
                good = words[low + k * p + part] == words[low + (k + 1) * p + part]
                low, high = low[good], high[good]
        if not len(low):
            continue
        open_ = ~found.covered(p, low, high)
        beyond = -1
        for g in low[open_].tolist():
            if g + reach * p < beyond:
                continue  # within the run found last
            a, b = int(owner_start[g]), int(owner_end[g])
            end = g + p + _alike(words[g : b - p], words[g + p : b])
            start = g - _alike(words[a:g][::-1], words[a + p : g + p][::-1])
            if end <= beyond:
                continue  # found already: stretches of one period that aren't one end apart
            beyond = end
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * p):
                continue
            root = words[start : start + 2 * p]
            if any((root[: 2 * p - p // r] == root[p // r :]).all() for r in _primes(p)):
                continue  # its smallest period is a divisor, at which it has been found
            found.put(p, start, end)
            out.append((start, end, p))
    return out


def _planted(words: np.ndarray, doc_id: int | None) -> np.ndarray | None:
    """For documents in ten by crc32, which word stands where after a stretch of the text is repeated to its end."""
    n = len(words)
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _joined(words: Words, places: np.ndarray) -> Iterator[bytes]:
    """The words at the given places, joined by one space, piece by piece."""
    for at in range(0, len(places), PIECE):
        own = places[at : at + PIECE]
        start, size = words.starts[own], words.ends[own] - words.starts[own] + 1  # with the white space after each
        end = np.cumsum(size)
        out = words.buffer[np.arange(end[-1]) + np.repeat(start - (end - size), size)]
        out[end - 1] = 32
        yield (out if at + PIECE < len(places) else out[:-1]).tobytes()


def _digest(parts: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part)
    return out.hexdigest()


def _periodic(repeated: bool):
    def periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            words = Words([texts[i] for i in order], lower=False)
            places = [np.arange(a, b) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            if repeated:
                for k, i in enumerate(order):
                    moved = _planted(places[k], ids[i])
                    if moved is not None:
                        places[k] = places[k][moved]
            yield _result([ids[i] for i in order], words, places)

    return periodic


def _result(ids: list, words: Words, places: list[np.ndarray]) -> pa.RecordBatch:
    by_size = sorted(range(len(places)), key=lambda k: -len(places[k]))
    sizes = np.array([len(places[k]) for k in by_size], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    line = np.concatenate([places[k] for k in by_size]) if len(by_size) else np.zeros(0, np.int64)
    runs = runs_of(words.hashes[line], first)
    of: dict[int, list[tuple[int, int, int]]] = {}
    for start, end, period in runs:
        k = int(np.searchsorted(first, start, "right")) - 1
        of.setdefault(k, []).append((start - int(first[k]), end - start, period))
    out = []
    for k, document in enumerate(by_size):
        own = sorted(of.get(k, []), key=lambda r: (r[0], r[2]))
        kept = places[document]
        if own:
            gone = np.zeros(len(kept) + 1, np.int64)
            for start, length, period in own:
                gone[start + period] += 1
                gone[start + length] -= 1
            kept = kept[np.cumsum(gone)[:-1] == 0]
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        out.append((ids[document], len(places[document]), len(own), *best, milli, digest, _digest(_joined(words, kept)), [{"start": s, "length": n, "period": p} for s, n, p in own]))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(struct)]
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(names), kinds, strict=True)], names)


def periodic_runs(documents: DataFrame, repeated: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_runs; start, length, period and exponent_milli of its longest run (ties: the
    least start, then the least period; nulls without a run); digests of all runs and of the text in which each run is
    collapsed to its first period; runs (start, length, period), in this order.

    Words are stretches without ASCII white space, as they are. With repeated=True a tenth of the documents, by the
    crc32 of doc_id, are taken with a stretch of theirs repeated to their end. A null or empty text has no words and
    no runs; a null doc_id stays null and nothing is repeated in it. Repeated rows give a row each, extra columns are
    ignored, and an empty table gives no rows. Every document is worked on where it lies: nothing is shuffled.
    """
    rows = narrow(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_periodic(repeated), RESULT)


def collapsed(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, each run of words collapsed to its first period; where there is none the text
    stays as it is, else its words are joined by one space. A null text stays null."""
    names = documents.columns
    at = names.index("text")

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            words = Words([texts[i] for i in order], lower=False)
            by_size = np.argsort(-words.counts, kind="stable")
            spans = [np.arange(words.first[k], words.first[k + 1]) for k in by_size]
            first = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
            line = np.concatenate([*spans, np.zeros(0, np.int64)])
            keep = np.ones(len(line), bool)
            for start, end, period in runs_of(words.hashes[line], first):
                keep[start + period : end] = False
            new = batch.column("text").to_pylist()
            for k, span in enumerate(spans):
                own = keep[first[k] : first[k + 1]]
                if not own.all():
                    new[order[by_size[k]]] = b"".join(_joined(words, span[own])).decode()
            columns = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(shorter, documents.schema)

