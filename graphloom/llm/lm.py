"""Language-model scores from an Elias-Fano n-gram trie, sharded over the corpus.

The model is a bigram model with a Dirichlet prior around smoothed unigrams:
p(w | v) = (c(v w) + M p(w)) / (c(v) + M). Its numerator depends on counts of w and of pairs that end in w, and its
denominator on v alone, so all that a word takes part in can be settled where that word's counts are: tokens are
shuffled once, to the shard of their word, together with a hash of the word before. Each shard counts its training
tokens, writes its trie to a memory-mapped file, looks up all its tokens in it and returns sums for each document. The
model so grows with the corpus and is never gathered in one place.

Words with over a shard's share of all tokens (fewer than there are shards) are dealt over all shards by the word
before them; their counts, known from the first pass, are broadcast.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, partitions, runs, text_bytes, written
from .eliasfano import Trie
from .words import U, Words

PRIOR = 500.0
ADDED = 0.1
HELD_OUT_OF = 10
SHARD_BYTES = 10_000_000
CHUNK = 3_000_000
_END, _BEGIN = U(0xE2D0F7E3C1B5A697), U(0xBE6140F0D3C2B1A5)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's hash, the hash of the token before it, and the number of its text; every text ends with one end."""
    words = Words(texts)
    token = np.insert(words.hashes, words.first[1:], _END)
    owner = np.repeat(np.arange(len(texts)), words.counts + 1)
    before = np.concatenate([[_BEGIN], token[:-1]]).astype(U)
    before[np.concatenate([[0], np.cumsum(words.counts + 1)[:-1]])] = _BEGIN
    return token, before, owner


def _training(docs: list[int | None]) -> np.ndarray:
    return np.array([not held_out(d) for d in docs], bool)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _counted(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's training tokens as (shard, sorted hashes, counts)."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            token, inverse = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return token, np.bincount(inverse, np.concatenate([c for _, c in held])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            token, n = merged()
            order, cut = _by_shard((token % U(shards)).astype(np.int64), shards)
            for s in range(shards):
                own = order[cut[s] : cut[s + 1]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([token[own].tobytes()], pa.binary()), pa.array([n[own].tobytes()], pa.binary())], ["shard", "tokens", "counts"])

        size = 0
        for batch in chunks(batches, "text", CHUNK):
            token, _, owner = _tokens(batch.column("text").to_pylist())
            held.append(np.unique(token[_training(batch.column("doc_id").to_pylist())[owner]], return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield from out()
                    held = []
                size = sum(len(t) for t, _ in held)
        if held:
            yield from out()

    return count


def _totals(shards: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's number of tokens and of different ones (a row without a token), and its frequent tokens."""
        for table in runs(batches, ["shard"]):
            shard = table.column("shard").to_numpy()
            token = [np.frombuffer(x, U) for x in table.column("tokens").to_pylist()]
            n = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                seen, inverse = np.unique(np.concatenate([token[i] for i in at]), return_inverse=True)
                count = np.bincount(inverse, np.concatenate([n[i] for i in at])).astype(np.int64)
                often = np.flatnonzero(count > count.sum() / shards)
                rows = [(None, int(count.sum()), len(seen)), *((int(seen[i].astype(np.int64)), int(count[i]), 0) for i in often)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["token", "n", "different"])

    return total


def _dealt(shards: int, hot: np.ndarray):
    names = ["shard", "chunk", "docs", "words", "lengths", "before", "owner", "n_docs", "n_training"]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int32(), pa.int32()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's tokens for each shard, sorted by word; and one row that only names the chunk's documents. Documents
        are numbered in their chunk, those for training first, so a cell needs no list of them."""
        chunk = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK):
            chunk += 1
            docs = batch.column("doc_id").to_pylist()
            train = _training(docs)
            first = np.argsort(~train, kind="stable")
            docs, n_training = [docs[i] for i in first], int(train.sum())
            token, before, owner = _tokens(batch.column("text").take(pa.array(first)).to_pylist())
            short = before.astype(np.uint32)
            where = np.where(np.isin(token, hot), short.astype(U) % U(shards), token % U(shards)).astype(np.int64)
            order = np.lexsort((token, where))
            cut = np.searchsorted(where[order], np.arange(shards + 1))
            ids = np.array([-(1 << 63) if d is None else d for d in docs], np.int64)
            n_tokens = np.bincount(owner, minlength=len(docs)).astype(np.int64)
            row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
            yield row(chunk % shards, chunk, ids.tobytes(), n_tokens.tobytes(), None, None, None, len(docs), n_training)
            owner = owner.astype(_owner_type(len(docs)))
            for s in range(shards):
                own = order[cut[s] : cut[s + 1]]
                if len(own):
                    new = np.flatnonzero(np.concatenate([[True], token[own][1:] != token[own][:-1]]))
                    lengths = np.diff(np.concatenate([new, [len(own)]])).astype(np.uint32)
                    yield row(s, chunk, None, token[own][new].tobytes(), lengths.tobytes(), short[own].tobytes(), owner[own].tobytes(), len(docs), n_training)

    return deal


def _owner_type(n_docs: int) -> type:
    return np.uint16 if n_docs <= 65536 else np.uint32


#: Sums travel as whole numbers of this part.
_UNIT = 2.0**-30


def _packed(sums: np.ndarray) -> bytes:
    """Sums as whole numbers of _UNIT, in as many bytes as the greatest needs, all first bytes first."""
    whole = np.round(sums / _UNIT).astype("<i8")
    width = (int(max(whole.max(), -whole.min() - 1, 0)).bit_length() + 8) // 8
    return np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, : len(planes)] = planes.T
    whole[:, len(planes) :] = np.where(planes[-1] >= 128, 255, 0)[:, None].astype(np.uint8)
    return whole.view("<i8").ravel() * _UNIT


def _settle(token: np.ndarray, before: np.ndarray, train: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's training count, and log10 of its numerator c(v w) + M p(w), by way of the shard's trie.

    unit: M p(w) for a word with a smoothed count of one.
    """
    order = np.lexsort((before[train], token[train]))
    w, v = token[train][order], before[train][order]
    if len(w):
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
        at = np.flatnonzero(new)
        pairs = np.diff(np.concatenate([at, [len(w)]]))
        w2, v2 = w[at], v[at]
        first = np.concatenate([np.flatnonzero(np.concatenate([[True], w2[1:] != w2[:-1]])), [len(w2)]])
        words = w2[first[:-1]]
        count = np.add.reduceat(pairs, first[:-1])
    else:
        pairs, v2, first, words, count = np.zeros(0, int), np.zeros(0, np.uint32), np.zeros(1, int), np.zeros(0, U), np.zeros(0, int)
    if len(hot) and len(words):
        place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        count = np.where(hot[place] == words, hot_counts[place], count)
    prior = (count + ADDED) * unit
    with tempfile.TemporaryDirectory() as folder:
        Trie.write(folder, words, np.log10(prior), first, v2, np.log10(pairs + np.repeat(prior, np.diff(first))))
        trie = Trie(folder)
        w = v = order = v2 = pairs = prior = None  # the trie has it all; what follows needs the room
        different, inverse = np.unique(token, return_inverse=True)
        inverse = inverse.astype(np.int32)
        node = trie.node(different)
        c = np.where(node >= 0, count[np.maximum(node, 0)] if len(count) else 0, 0)
        if len(hot):  # a frequent word may have no training token here
            place = np.minimum(np.searchsorted(hot, different), len(hot) - 1)
            c = np.where(hot[place] == different, hot_counts[place], c)
        c, node = c[inverse], node[inverse]
        value = np.log10((c + ADDED) * unit)
        known = np.flatnonzero(node >= 0)
        value[known] = trie.value(node[known], before[known])
        del trie
    return c, value


def _scored(hot: np.ndarray, hot_counts: np.ndarray, unit: float, prior: float):
    names = ["chunk", "docs", "n_tokens", "owners", "unknown", "base", "score"]
    types = [pa.int64(), *[pa.binary()] * 6]
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk of a shard, sums of the documents that have tokens there; rows that name documents pass."""

        def shard_rows() -> Iterator[pa.Table]:
            for table in runs(batches, ["shard"]):
                shard = table.column("shard").to_numpy()
                cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    yield table.slice(int(s), int(e - s))

        for table in shard_rows():
            rows = table.to_pylist()
            for r in rows:
                if r["docs"] is not None:
                    yield row(r["chunk"], r["docs"], r["words"], None, None, None, None)
            rows, table = [r for r in rows if r["docs"] is None], None
            if not rows:
                continue
            token = np.concatenate([np.repeat(np.frombuffer(r["words"], U), np.frombuffer(r["lengths"], np.uint32)) for r in rows])
            before = np.concatenate([np.frombuffer(r["before"], np.uint32) for r in rows])
            owners = [np.frombuffer(r["owner"], _owner_type(r["n_docs"])) for r in rows]
            train = np.concatenate([o < r["n_training"] for r, o in zip(rows, owners, strict=True)])
            for r in rows:
                r["words"] = r["lengths"] = r["before"] = None
            count, value = _settle(token, before, train, hot, hot_counts, unit)
            # A word is the context of the token after it; an end is of none.
            value -= np.where(token == _END, 0.0, np.log10(count + prior))
            base = np.log10(count + ADDED)
            at = 0
            for r, o in zip(rows, owners, strict=True):
                own = slice(at, at + len(o))
                at += len(o)
                seen, inverse = np.unique(o, return_inverse=True)
                unknown = np.bincount(inverse, count[own] == 0).astype(np.uint32)
                sums = np.bincount(inverse, value[own]).astype(np.float32)
                yield row(r["chunk"], None, None, seen.astype(np.uint32).tobytes(), unknown.tobytes(), _packed(np.bincount(inverse, base[own])), sums.tobytes())

    return score


def _summed(n_training: int, vocabulary: int, begin: float):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["chunk"]):
            by: dict[int, list[dict]] = {}
            for r in table.to_pylist():
                by.setdefault(r["chunk"], []).append(r)
            for rows in by.values():
                named = next(r for r in rows if r["docs"] is not None)
                docs, n_tokens = np.frombuffer(named["docs"], np.int64), np.frombuffer(named["n_tokens"], np.int64)
                known, base, score = n_tokens.copy(), np.zeros(len(docs)), np.zeros(len(docs))
                for r in rows:
                    if r["docs"] is None:
                        at = np.frombuffer(r["owners"], np.uint32)
                        known[at] -= np.frombuffer(r["unknown"], np.uint32)
                        base[at] += _unpacked(r["base"], len(at))
                        score[at] += np.frombuffer(r["score"], np.float32)
                ids = pa.array(docs, mask=docs == -(1 << 63))
                out = pa.array([held_out(d) for d in ids.to_pylist()])
                base = base - n_tokens * np.log10(n_training + ADDED * (vocabulary + 1))
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(n_tokens), pa.array(known), pa.array(np.full(len(docs), n_training)), pa.array(base), pa.array(score - begin)], SCHEMA.replace(",", "").split()[0::2])

    return finish


def score(documents: DataFrame, prior: float = PRIOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end. Repeated rows count and are scored each. A null doc_id is held out.
    Scores are log10; without training tokens every word is unknown. Extra columns are ignored; an empty table gives no
    rows. `score` sums quantised values (a byte each), in single precision for each shard.
    """
    spark = documents.sparkSession
    rows = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(4, -(-int(size) // shard_bytes))
    n = partitions(spark)
    counts = rows.mapInArrow(_counted(shards), "shard int, tokens binary, counts binary").repartition(n, "shard").sortWithinPartitions("shard")
    totals = written(counts.mapInArrow(_totals(shards), "token long, n long, different long"))
    n_training, vocabulary = (x or 0 for x in totals.filter("token IS NULL").agg(F.sum("n"), F.sum("different")).first())
    # A token with over 1/shards of all: there are fewer than `shards`.
    often = sorted((int(np.int64(r["token"]).astype(U)), r["n"]) for r in totals.filter(F.col("token").isNotNull() & (F.col("n") > n_training / shards)).collect())
    hot, hot_counts = np.array([h for h, _ in often], U), np.array([c for _, c in often], np.int64)
    n_documents = rows.filter(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_OF)) != 0).count()
    unit = prior / (n_training + ADDED * (vocabulary + 1))

    dealt = rows.mapInArrow(_dealt(shards, hot), "shard int, chunk long, docs binary, words binary, lengths binary, before binary, owner binary, n_docs int, n_training int")
    sums = dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_scored(hot, hot_counts, unit, prior), "chunk long, docs binary, n_tokens binary, owners binary, unknown binary, base binary, score binary")
    begin = float(np.log10(n_documents + prior))
    return sums.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(_summed(n_training, vocabulary, begin), SCHEMA)
