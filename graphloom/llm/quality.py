"""Quality rules: counts of each text, and a calibrated logistic regression over hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (`sample` rows of each class, the least by a hash of doc_id;
this bound is a parameter) and scores every document in Arrow batches. Thresholds are fixed numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, narrow, text_bytes
from .words import U, Words, mix

BUCKETS = 1 << 14
#: Word n-grams and character (code point) n-grams; each family has BUCKETS weights and its counts are divided by their sum.
FAMILIES = (("word", 1), ("word", 2), ("char", 2), ("char", 4))
SAMPLE_PER_CLASS = 1000
KEEP_FROM = 0.5
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("p_quality", T.DoubleType())]
)


def _grams(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each family: its number, the text of each n-gram, and the n-gram's bucket."""
    owners = words.owners()
    lowered, of_character = _characters(words)
    for number, (kind, k) in enumerate(FAMILIES):
        if kind == "word":
            values, at = words.grams(k)
            yield number, owners[at], (values % U(BUCKETS)).astype(np.int64)
        else:
            n = len(lowered) - k + 1
            if n <= 0:
                continue
            value = np.zeros(n, np.uint32)
            for i in range(k):
                value = value * np.uint32(0x01000193) + lowered[i : i + n]
            value ^= value >> np.uint32(15)
            same = np.flatnonzero(of_character[:n] == of_character[k - 1 : k - 1 + n])
            yield number, of_character[same], ((value[same] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)).astype(np.int64)


def _characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, A-Z lowered, and the text of each. Bytes that are no UTF-8 stand for themselves."""
    raw = words.buffer.tobytes()
    try:
        text, begins = raw.decode(), (words.buffer & 0xC0) != 0x80
    except UnicodeDecodeError:
        text, begins = raw.decode("latin-1"), np.ones(len(raw), bool)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    points[(points >= 65) & (points <= 90)] += 32
    offsets = np.concatenate([[0], np.cumsum(begins)])[words.offsets]
    return points, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def _rates(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features (family * BUCKETS + bucket) and their share of the family's n-grams."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in words.counts]
    for number, owner, bucket in _grams(words):
        key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(parts) + 1) * BUCKETS)
        for i in range(len(parts)):
            if cut[i] < cut[i + 1]:
                part = count[cut[i] : cut[i + 1]]
                parts[i].append((key[cut[i] : cut[i + 1]] - i * BUCKETS + number * BUCKETS, part / part.sum()))
    empty = (np.zeros(0, np.int64), np.zeros(0))
    return [tuple(map(np.concatenate, zip(*p, strict=True))) if p else empty for p in parts]


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text. Words and lines are compared as they stand, case included."""
    words = Words(texts, lower=False)
    n = len(texts)
    buffer = words.buffer
    space = np.isin(buffer, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    of_byte = words.offsets
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[of_byte])
    repeats = np.zeros(n, np.int64)
    values, at = words.grams(3)
    if len(values):
        owners = words.owners()
        with np.errstate(over="ignore"):
            _, inverse, count = np.unique(values + mix(owners[at].astype(U)), return_inverse=True, return_counts=True)
        begin = at[count[inverse] > 1]
        covered = np.zeros(len(words.hashes), bool)
        for i in range(3):
            covered[begin + i] = True
        repeats = np.bincount(owners[covered], minlength=n)
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        worded = [line for line in text.split(b"\n") if line.strip()]
        lines[i] = len(worded) - len(set(worded))
    return {
        "n_words": words.counts,
        "word_chars": total(~space & ((buffer & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[buffer]),
        "n_dup_lines": lines,
        "n_repeat_words": repeats,
    }


def base_failed(found: dict[str, np.ndarray], min_words: int = MIN_WORDS) -> np.ndarray:
    return (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > 50 * found["n_words"])


class Model:
    """Weights of every feature, and the two numbers that turn a margin into a probability."""

    def __init__(self, weights: np.ndarray, slope: float, base: float):
        self.weights, self.slope, self.base = weights.astype(np.float32), slope, base

    def margins(self, texts: list[bytes]) -> np.ndarray:
        words = Words(texts)
        out = np.zeros(len(texts))
        for number, owner, bucket in _grams(words):
            weights = self.weights[number * BUCKETS : (number + 1) * BUCKETS]
            count = np.bincount(owner, minlength=len(texts))
            out += np.bincount(owner, weights[bucket], minlength=len(texts)) / np.maximum(count, 1)
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.base, -40, 40)))


def _descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights of least logistic loss by Adam, from rows of (features, values)."""
    row = np.repeat(np.arange(len(x)), [len(f) for f, _ in x])
    at, value = np.concatenate([f for f, _ in x]), np.concatenate([v for _, v in x])
    used, at = np.unique(at, return_inverse=True)
    value = value / np.sqrt(np.bincount(at, value * value) / len(x))[at]  # every feature counts alike
    scale = np.sqrt(np.bincount(at, np.concatenate([v for _, v in x]) ** 2) / len(x))
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    bias = 0.0
    for t in range(1, steps + 1):
        margin = np.bincount(row, value * w[at], minlength=len(x)) + bias
        gap = share * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        g = np.bincount(at, value * gap[row], minlength=len(used)) + 1e-5 * w
        bias -= 0.5 * gap.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.005 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    out = np.zeros(len(FAMILIES) * BUCKETS)
    out[used] = w / scale
    return out


def _calibrated(margin: np.ndarray, y: np.ndarray, good: float) -> tuple[float, float]:
    """Platt's slope and base, by Newton's steps on smoothed targets; `good` is the share of good rows among all labelled."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(y == 1, good / n1, (1 - good) / n0)
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones_like(margin)])
    ab = np.array([1.0, -margin.mean() / spread])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -40, 40)))
        g = x @ (share * (p - target)) + 1e-4 * ab
        h = (x * (share * p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(ab[0] / spread), float(ab[1])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, min_words: int = MIN_WORDS) -> Model | None:
    """Fit and calibrate on at most `sample` labelled rows a class. None if a class has under ten rows of use.

    Rows that fail the base rule are not used, as the model never decides on them. Probabilities are calibrated to the
    share of good rows among all labelled ones. A document labelled more than once takes the mean of its
    labels, and one that stands in several rows is learnt once, from its least text; null ids, null labels and null texts are left out.
    """
    marks = narrow(labels, doc_id="doc_id", quality="quality").dropna().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = marks.filter(F.col("quality") == 1).orderBy(order, "doc_id").limit(sample).unionByName(marks.filter(F.col("quality") == 0).orderBy(order, "doc_id").limit(sample))
    share = marks.agg(F.avg("quality")).first()[0]
    docs = narrow(documents, doc_id="doc_id", text="text").filter(F.col("text").isNotNull())
    # At most 2 * sample ids: a bounded broadcast.
    # One row a document, whatever rows repeat its id.
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("doc_id", "quality", text_bytes().alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            failed = base_failed(measures(batch.column("text").to_pylist()), min_words)
            batch = batch.filter(pa.array(~failed))
            found = _rates(Words(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["doc_id", "quality", "features", "rates"],
            )

    got = rows.mapInArrow(featured, "doc_id long, quality int, features binary, rates binary").toArrow().sort_by("doc_id")
    y = np.array(got.column("quality").to_pylist(), np.int64)
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return None
    x = [(np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for f, v in zip(got.column("features").to_pylist(), got.column("rates").to_pylist(), strict=True)]
    order = mix(np.array(got.column("doc_id").to_pylist(), np.int64).astype(U))
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # a quarter of each class calibrates
        own = np.flatnonzero(y == c)
        held[own[np.argsort(order[own], kind="stable")][: max(2, len(own) // 4)]] = True
    weights = _descend([x[i] for i in np.flatnonzero(~held)], y[~held])
    margin = np.array([sum(weights[f] * v) for f, v in (x[i] for i in np.flatnonzero(held))])
    return Model(weights, *_calibrated(margin, y[held], share))


def judge(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, keep_from: float = KEEP_FROM, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with its counts, base verdict, calibrated quality and final verdict.

    A null or empty text has no words and fails the base rule; so does one under `min_words` words or with over half of
    its words in repeated 3-word windows. Repeated rows get a row each. Without a usable model (too few labels) quality
    is null and the base rule decides. Extra columns are ignored. An empty table gives no rows.
    """
    verdict = _judge(documents, labels, sample, keep_from, min_words)
    names = [f.name for f in SCHEMA.fields]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found, failed, kept, quality = verdict(batch.column("text").to_pylist())
            arrays = [batch.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in names[1:6]), pa.array(failed), pa.array(kept), pa.array(quality, mask=np.isnan(quality))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(scored, SCHEMA)


def _judge(documents: DataFrame, labels: DataFrame, sample: int, keep_from: float, min_words: int):
    """A function for tasks: (counts, base verdicts, final verdicts, qualities) of a list of texts."""
    model = fit(documents, labels, sample, min_words)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most len(FAMILIES) * BUCKETS weights

    def verdict(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        found = measures(texts)
        failed = base_failed(found, min_words)
        quality = shared.value.probabilities(texts) if shared.value else np.full(len(texts), np.nan)
        return found, failed, ~failed & ~(quality < keep_from), quality

    return verdict


def passed(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, keep_from: float = KEEP_FROM, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, that `judge` keeps; each row is judged by its own text."""
    verdict = _judge(documents, labels, sample, keep_from, min_words)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(verdict([(t or "").encode() for t in batch.column("text").to_pylist()])[2]))

    return documents.mapInArrow(kept, documents.schema)
