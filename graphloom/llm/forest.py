"""Approximate nearest neighbours by inner product, with a forest of hash-prefix trees.

1. Equal vectors make one class; only the least vec_id of a class goes on, and its copies come back at the end.
2. Each of TREES trees gives a vector a string of BITS signs of projections. One more component, which makes all lengths
   equal, turns the largest inner product into the least angle. The strings of all trees stand in one order, dealt over
   range partitions: sorted arrays, in which the rows that share a prefix are neighbours.
3. Descent: a query's string is looked up in each array, and for every prefix length the rows that share it are counted.
   Prefixes that lie across borders of partitions get the sum of their parts.
4. Ascent: all trees of a query go up together, from the longest prefix on, to the first length at which they hold
   `wanted` candidates between them. `wanted` is the least number at which queries of a sample, held against all vectors,
   find TARGET of their true neighbours; at most every candidate is wanted.
5. The arrays are cut into blocks. A block gets the queries whose prefix has rows in it, compares each with all of these
   rows, however many, and gives the best. The best of all trees and blocks, in double precision, are the result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow, partitions, runs, written

TREES = 16
BITS = 40
#: Queries, the least by a hash of their vec_id, that set how far the ascent goes, and what they are to find.
SAMPLE_QUERIES = 128
TARGET = 0.95
#: Rows of a block, and the most blocks: the broadcast list of their borders has 16 bytes for each.
BLOCK = 4096
MOST_BLOCKS = 1 << 19
#: The most range partitions of the descent; for each, 2 * (BITS + 1) counts of 16 bytes are broadcast.
MOST_PARTS = 1 << 15
#: Scores that a task holds at one time, and the room that they leave for rounding in single precision.
SCORES = 2_000_000
ROUNDING = 1e-5

RESULT = "query_id long, rank int, vec_id long, score double"


def _matrix(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up with zeros, and which of them take part."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()  # leaves out null vectors
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(dtype)
    out = np.zeros((len(column), max(1, int(lengths.max(initial=0)))), dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    good = valid & np.isfinite(out).all(axis=1)
    good[good] = (out[good] != 0).any(axis=1)
    return out + 0.0, good  # no negative zeros, so that equal vectors have equal bytes


def _read(dtype: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that take part as bytes without zeros at the end, a 128-bit key of these, and their length."""
        for batch in batches:
            rows, good = _matrix(batch.column("vector"), dtype)
            good &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            rows, size = rows[good], np.dtype(dtype).itemsize
            data = [r.tobytes() for r in rows]
            keys = [hashlib.blake2b(x.rstrip(b"\0"), digest_size=16).digest() for x in data]
            low, high = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            used = [size * (int(np.flatnonzero(r)[-1]) + 1) for r in rows]
            data = [x[:n] for x, n in zip(data, used, strict=True)]
            ids = batch.column("vec_id").filter(pa.array(good))
            most = np.abs(rows).max(axis=1, initial=0).astype(float)
            norm = most * np.sqrt(((rows / np.maximum(most, np.finfo(float).tiny)[:, None]) ** 2).sum(axis=1))
            dims = pa.array([n // size for n in used], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(low.copy()), pa.array(high.copy()), pa.array(norm), dims, pa.array(data, pa.binary())], ["vec_id", "low", "high", "norm", "dims", "vector"])

    return read


class Space:
    """What all vectors have in common: how they are stored, their most components and their greatest length."""

    def __init__(self, dtype: str, dims: int, longest: float):
        self.dtype, self.dims, self.longest = dtype, dims, longest

    def vectors(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        size = self.dims * np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in column.to_pylist()), self.dtype).reshape(-1, self.dims)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """Rows as stored, in parts of the greatest length."""
        return rows.astype(np.float64) / self.longest

    def strings(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """A column of keys for each tree: its number, and the signs of BITS projections as one whole number."""
        x = self.scaled(rows)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        weights = _projections(self.dims + 1)
        out = np.empty((len(x), TREES), np.int64)
        for tree in range(TREES):
            signs = (np.column_stack([x, last]) @ weights[tree]) > 0
            out[:, tree] = (tree << BITS) | (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)))
        return out


@functools.cache
def _projections(dims: int) -> np.ndarray:
    """For each tree BITS directions, at right angles to one another as far as there is room."""
    draw = np.random.default_rng(20240229)
    out = np.empty((TREES, dims, BITS))
    for tree in range(TREES):
        parts = [np.linalg.qr(draw.normal(size=(dims, min(dims, BITS))))[0] for _ in range(-(-BITS // dims))]
        out[tree] = np.concatenate(parts, axis=1)[:, :BITS]
    return out


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix over all trees."""
    differ = p ^ q  # of one tree, so its number drops out
    return (BITS - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0)).max(axis=-1).astype(np.int32)


def _strings(space: Space):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree and vector, and one more as a query."""
        for batch in batches:
            ids, rows = batch.column("rep").to_numpy(), space.vectors(batch.column("vector"))
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for kind, own in ((0, np.arange(len(ids))), (1, np.flatnonzero(asked))):
                keys = space.strings(rows[own], bool(kind))
                for tree in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int8)), pa.array(keys[:, tree].copy()), pa.array(ids[own])], ["kind", "key", "id"])

    return strings


_LEVELS = np.arange(BITS + 1)
_DESCENT = "id long, key long, level int, n long, counts array<long>"


def _span(key: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest key that share their first `level` signs with key."""
    free = (np.int64(1) << (BITS - level).astype(np.int64)) - 1
    return key & ~free, key | free


def _descend(block: int):
    names = _DESCENT.replace(",", "").split()[0::2]

    def rows(size: int, **given) -> pa.RecordBatch:
        kinds = dict(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in kinds.items()], names)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over a sorted range: of each query the rows that share each prefix, -1 where the prefix may lie across a
        border; parts of the prefixes at the borders (key, level, n); first rows of blocks (key, id)."""
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("id", pa.int64())]))
        if not table.num_rows:
            return
        kind, key, ids = (table.column(c).to_numpy() for c in ("kind", "key", "id"))
        own, own_ids = key[kind == 0], ids[kind == 0]
        count = lambda low, high: np.searchsorted(own, high, "right") - np.searchsorted(own, low, "left")
        edges = np.unique(np.concatenate([np.stack([_span(np.array([k]), _LEVELS)[0], _LEVELS], axis=1) for k in (key[0], key[-1])]), axis=0)
        low, high = _span(edges[:, 0], edges[:, 1])
        yield rows(len(edges), key=edges[:, 0].copy(), level=edges[:, 1].astype(np.int32), n=count(low, high))
        yield rows(len(own[::block]), key=own[::block].copy(), id=own_ids[::block].copy())
        asked, asked_ids = key[kind == 1], ids[kind == 1]
        for at in range(0, len(asked), 20_000):
            part = asked[at : at + 20_000]
            counts = np.empty((len(part), BITS + 1), np.int64)
            for level in _LEVELS:
                low, high = _span(part, level)
                counts[:, level] = np.where((low > key[0]) & (high < key[-1]), count(low, high), -1)
            offsets = pa.array(np.arange(0, counts.size + 1, BITS + 1, dtype=np.int32))
            yield rows(len(part), id=asked_ids[at : at + 20_000].copy(), key=part.copy(), counts=pa.ListArray.from_arrays(offsets, pa.array(counts.ravel())))

    return descend


def _totals(edges):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query, by prefix length, the candidates of all trees."""
        at, n = edges.value
        for table in runs(batches, ["id"]):
            ids, key = table.column("id").to_numpy(), table.column("key").to_numpy()
            counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, BITS + 1).copy()
            for level in _LEVELS:
                open_ = np.flatnonzero(counts[:, level] < 0)
                prefix = (_span(key[open_], level)[0] << 6) | level
                counts[open_, level] = n[np.searchsorted(at, prefix)]
            first = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0]))
            sums = np.add.reduceat(counts, first, axis=0)
            offsets = pa.array(np.arange(0, sums.size + 1, BITS + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["id", "totals"])

    return totals


def _true(space: Space, ids: np.ndarray, queries: np.ndarray, k: int):
    """A partition's nearest rows to the queries of the sample, and how long a prefix they share with them."""

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, strings = space.scaled(queries), space.strings(queries, True)
        best: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for batch in batches:
            own, rows = batch.column("rep").to_numpy(), space.vectors(batch.column("vector"))
            keys = space.strings(rows, False)
            for at in range(0, len(own), 4000):
                scores = asked @ space.scaled(rows[at : at + 4000]).T
                for i, row in enumerate(scores):
                    top = np.argpartition(-row, min(k, len(row) - 1))[: k + 1] + at
                    found = zip(scores[i, top - at].tolist(), own[top].tolist(), _shared(keys[top], strings[i]).tolist(), strict=True)
                    best[i] = sorted([*best[i], *(x for x in found if x[1] != ids[i])], reverse=True)[:k]
        out = [(int(q), *x) for q, found in zip(ids, best, strict=True) for x in found]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["query", "score", "id", "shared"])

    return true


def wanted_candidates(totals: dict[int, np.ndarray], shared: dict[int, list[int]], target: float) -> int:
    """The least number of candidates with which the queries of the sample find `target` of their true neighbours."""
    if not shared:
        return 1
    most = max(int(t[0]) for t in totals.values())
    # Only a number that is some query's count at some length changes anything.
    steps = np.unique(np.concatenate([totals[q] for q in shared]))
    low, high = 0, len(steps) - 1
    found = lambda m: sum(sum(s >= (totals[q] >= min(m, totals[q][0])).sum() - 1 for s in x) for q, x in shared.items())
    needed = target * sum(map(len, shared.values()))
    while low < high:  # more candidates never find fewer
        middle = (low + high) // 2
        if found(steps[middle]) >= needed:
            high = middle
        else:
            low = middle + 1
    return min(int(steps[low]), most)


def _block_of(key: np.ndarray, ids: np.ndarray, border: np.ndarray, border_id: np.ndarray) -> np.ndarray:
    """The block of each row: the last whose first (key, id) is not beyond it."""
    low, high = np.searchsorted(border, key, "left"), np.searchsorted(border, key, "right")
    out = low - 1
    for k in np.unique(key[high > low]):  # keys at which blocks begin; those of many equal rows have several
        own = np.flatnonzero(key == k)
        a, b = low[own[0]], high[own[0]]
        out[own] = a - 1 + np.searchsorted(border_id[a:b], ids[own], "right")
    return np.maximum(out, 0)


_BLOCKED = "block int, kind byte, key long, top long, id long, vector binary"


def _blocked(space: Space, borders):
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree and vector in its block, and one for each query, tree and block in which its prefix may lie."""
        border, border_id = borders.value
        names = _BLOCKED.replace(",", "").split()[0::2]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, vector = batch.column("rep").to_numpy(), batch.column("vector")
                rows, level = space.vectors(vector), batch.column("level").to_numpy(zero_copy_only=False)
                keys = space.strings(rows, False)
                for tree in range(TREES):
                    key = keys[:, tree].copy()
                    yield pa.RecordBatch.from_arrays([pa.array(_block_of(key, ids, border, border_id).astype(np.int32)), pa.array(np.zeros(len(ids), np.int8)), pa.array(key), pa.array(key), pa.array(ids), vector], names)
                own = np.flatnonzero(level >= 0)
                keys, level = space.strings(rows[own], True), level[own].astype(np.int64)
                for tree in range(TREES):
                    low, high = _span(keys[:, tree], level)
                    first = np.maximum(np.searchsorted(border, low, "left") - 1, 0)
                    n = np.searchsorted(border, high, "right") - first
                    each = np.repeat(np.arange(len(own)), n)
                    block = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.ones(len(each), np.int8)), pa.array(low[each]), pa.array(high[each]), pa.array(ids[own][each]), vector.take(pa.array(own[each]))], names)

    return blocked


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, nearest first, ties to the lesser id."""
    order = np.lexsort((ids, -score, query))
    first = np.flatnonzero(np.concatenate([[True], np.diff(query[order]) != 0])[: len(order)])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    return order[rank < k]


def _searched(space: Space, k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's best rows of a block, among all that share its prefix. A block's rows come before its queries."""
        held, current, block_rows = [], None, None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *change], [*change, len(block)], strict=True):
                if s == e:
                    continue
                part = batch.slice(int(s), int(e - s))
                if block[s] != current:
                    held, current, block_rows = [], block[s], None
                if kind[s] == 0:
                    held.append(part)
                    continue
                if block_rows is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    rows = space.vectors(table.column("vector"))
                    block_rows = table.column("key").to_numpy(), table.column("id").to_numpy(), rows, space.scaled(rows).astype(np.float32)
                    held = []
                yield from answers(part, *block_rows)

    def answers(part: pa.RecordBatch, key: np.ndarray, ids: np.ndarray, rows: np.ndarray, scaled: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, top, asked = (part.column(c).to_numpy() for c in ("key", "top", "id"))
        queries = space.vectors(part.column("vector"))
        unit = queries.astype(np.float64)
        unit = unit / np.abs(unit).max(axis=1)[:, None]
        unit = (unit / np.sqrt((unit * unit).sum(axis=1))[:, None]).astype(np.float32)
        order = np.lexsort((top, low))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(top[order]) != 0)]))
        for s, e in zip(first, [*first[1:], len(order)], strict=True):
            i, j = np.searchsorted(key, low[order[s]], "left"), np.searchsorted(key, top[order[s]], "right")
            step = max(1, SCORES // max(1, j - i))
            for a in range(s, e if j > i else s, step):
                own = order[a : min(e, a + step)]
                near = unit[own] @ scaled[i:j].T
                if j - i > k:
                    least = np.partition(near, j - i - k, axis=1)[:, j - i - k]
                    q, r = np.nonzero(near >= least[:, None] - ROUNDING)
                else:
                    q, r = (x.ravel() for x in np.indices(near.shape))
                q, r = own[q], r + i
                score = np.concatenate([(queries[q[b : b + 50_000]].astype(np.float64) * rows[r[b : b + 50_000]]).sum(axis=1) for b in range(0, len(q), 50_000)])
                at = _best(q, ids[r], score, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q[at]]), pa.array(ids[r[at]]), pa.array(score[at])], ["query", "id", "score"])

    return searched


def _classes(rows: DataFrame, queried: Column) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep, asked) of all that take part, and (rep, asked, vector) of the classes of equal vectors."""
    one = rows.groupBy("vec_id").agg(F.min(F.struct("low", "high")).alias("key")).select("vec_id", "key.low", "key.high", F.coalesce(queried, F.lit(False)).alias("asked"))
    one = written(one)
    reps = one.groupBy("low", "high").agg(F.min("vec_id").alias("rep"), F.max("asked").alias("wanted"))
    # One row a class on the right, so a class of very many copies can be split on the left.
    members = written(one.join(reps, ["low", "high"]).select("vec_id", "rep", "low", "high", "asked", "wanted"))
    own = members.filter("vec_id = rep").select("vec_id", "low", "high", "wanted")
    classes = rows.join(own, ["vec_id", "low", "high"]).select(F.col("vec_id").alias("rep"), F.col("wanted").alias("asked"), "vector").dropDuplicates(["rep"])
    return members.select("vec_id", "rep", "asked"), written(classes)


def nearest(vectors: DataFrame, k: int = 20, queried: Column | None = None, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product with each query, nearest first,
    ties to the lesser id; queries are the rows that `queried`, over the column vec_id, picks (all, if it is None).

    score is the inner product of the original vectors in double precision, and every row but the query's own may be
    found; with fewer than k others there are fewer rows. Which are found is probabilistic: about `target` of the true ones, and all
    if that is 1. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
    id. A shorter vector counts as if zeros followed. Rows that repeat an id and its vector count once; of different
    vectors of one id the one with the least key of its bytes takes part. Extra columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[vector].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = narrow(vectors, vec_id=key, vector=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<float>" if dtype == "<f4" else "array<double>").alias("vector"))
    rows = written(rows.mapInArrow(_read(dtype), "vec_id long, low long, high long, norm double, dims int, vector binary"))
    dims, longest = rows.agg(F.max("dims"), F.max("norm")).first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    space, n = Space(dtype, dims, longest), partitions(spark)
    members, classes = _classes(rows.drop("norm", "dims"), F.lit(True) if queried is None else queried)

    # Descent: counts by prefix length, and the borders of blocks.
    block = max(BLOCK, -(-TREES * classes.count() // MOST_BLOCKS))
    strings = classes.mapInArrow(_strings(space), "kind byte, key long, id long")
    met = written(strings.repartitionByRange(min(n, MOST_PARTS), "key", "id").sortWithinPartitions("key", "id").mapInArrow(_descend(block), _DESCENT))
    edges = met.filter("level IS NOT NULL").groupBy("key", "level").agg(F.sum("n").alias("n")).toArrow()  # 2 * (BITS + 1) a partition
    at, counts = (edges.column("key").to_numpy() << 6) | edges.column("level").to_numpy(), edges.column("n").to_numpy()
    edges = spark.sparkContext.broadcast((np.sort(at), counts[np.argsort(at)]))
    open_ = met.filter("counts IS NOT NULL").select("id", "key", "counts")
    totals = written(open_.repartition(n, "id").sortWithinPartitions("id").mapInArrow(_totals(edges), "id long, totals array<long>"))

    # Ascent: how many candidates the queries of a sample need.
    sample = classes.filter("asked").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_QUERIES).select("rep", "vector").toArrow()
    ids = sample.column("rep").to_numpy()
    true = classes.select("rep", "vector").mapInArrow(_true(space, ids, space.vectors(sample.column("vector")), k), "query long, score double, id long, shared int")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = true.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).groupBy("query").agg(F.collect_list("shared").alias("shared"))
    shared = {r["query"]: r["shared"] for r in true.collect()}  # at most SAMPLE_QUERIES of k numbers
    of_sample = totals.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "id long")), "id").collect()
    wanted = wanted_candidates({r["id"]: np.array(r["totals"]) for r in of_sample}, shared, target)
    levels = totals.select(F.col("id").alias("rep"), (F.size(F.filter("totals", lambda x: x >= F.least(F.lit(wanted), F.element_at("totals", 1)))) - 1).alias("level"))

    # Search, block by block.
    starts = met.filter("level IS NULL AND counts IS NULL").select("key", "id").orderBy("key", "id").toArrow()  # at most MOST_BLOCKS, and one a partition
    borders = spark.sparkContext.broadcast((starts.column("key").to_numpy(), starts.column("id").to_numpy()))
    blocks = classes.join(levels, "rep", "left").select("rep", "vector", F.coalesce("level", F.lit(-1)).alias("level")).mapInArrow(_blocked(space, borders), _BLOCKED)
    found = blocks.repartition(n, "block").sortWithinPartitions("block", "kind", "key").mapInArrow(_searched(space, k + 1), "query long, id long, score double")
    # A query's own class may be the first; with k + 1 each, k others are among them.
    ranked = lambda df, by, most, last: df.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), last))).filter(F.col("at") <= most).drop("at")
    found = written(ranked(found.groupBy("query", "id").agg(F.max("score").alias("score")), "query", k + 1, "id"))
    few = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("at") <= k + 1).select(F.col("rep").alias("id"), "vec_id")
    found = ranked(found.join(few, "id").select("query", "vec_id", "score"), "query", k + 1, "vec_id")
    found = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))  # k + 1 at most
    asked = members.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(found, "query").select("query_id", F.posexplode(near).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "near.vec_id", (-F.col("near.minus")).alias("score"))
