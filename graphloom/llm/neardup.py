"""Near-duplicate documents by an LSH forest over MinHash signatures, with every link confirmed on full shingle sets.

1. Each text gives its set of 5-word shingles, TREES * DEPTH least hashes, and a key of the whole set. Equal sets make
   one class; only its least doc_id goes on.
2. The signature is read in TREES rotated orders. Documents that share their first DEPTH values in an order form a
   region. Where a region holds over REGION documents its depth grows by two values with each doubling, so that it falls
   into blocks of longer common prefixes.
3. In each block, sorted by the values that follow its depth, so that longest-common-prefix neighbours stand together, a
   document is proposed to the leader it resembles most (signatures agree in MAYBE of the values or more); unless they
   agree in NEAR of them, it leads others itself. A block of over PART documents is dealt over salts; the leaders of all
   salts meet again in a block of their own, until no block is so large. In large regions, which blocks divide, every
   document is proposed to the region's first, too.
4. Each document's best proposal is confirmed on full sets; confirmed links make components. Then every block that holds
   documents of different components gets their full sets, and there each pair that might still be linked (agreement of
   at least MAYBE) is compared, best first, until the block's documents are of one component or no such pair is left. A
   block gives fewer links than it has documents.
5. What the forest has missed is found by full sets. A linked set lacks at most 25 % of a document's shingles, so documents
   that hold more than that alone, of three eighths of all shingles, can have no link to another component. Of the others,
   the shingles that several components hold are put in one order, the rarest first; pairs that meet in one, and whose
   places there leave room for a link, are confirmed like the others. This step is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Ids, chunks, given_back, narrow, partitions, runs, text_bytes, without, written
from .components import components
from .words import U, Words, mix, shingle_sets

WORDS = 5
PERCENT = 75
TREES = 32
DEPTH = 4
REGION = 256
PART = 16 * REGION
NEAR = 0.80
MAYBE = 0.58
#: The share of documents from which frequent shingles are told, and the least number of them; in how many of these they
#: stand, and how many are told at most. They count as held by several components without being shuffled; any give the same links.
SAMPLE = 0.01
LEAST_SAMPLE = 5000
FREQUENT = 4
MOST_FREQUENT = 100_000
#: Shingles whose hash is less are looked at first: three eighths of all. Of a quarter a linked set might hold none.
SCREEN = U(3 << 61)
#: Classes of set sizes for each factor of e: eight for 4/3.
SIZE_CLASSES = 28
#: Rows of a part of those that hold a shingle and are of one size class.
SIDE = 512

_SIZE = TREES * DEPTH
_ODD = (mix(np.arange(1000, 1000 + _SIZE, dtype=U)) & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_FLIP = (mix(np.arange(5000, 5000 + _SIZE, dtype=U)) & U(0xFFFFFFFF)).astype(np.uint32)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of _SIZE least hashes for each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), _SIZE), np.uint32)
    if not len(sets):
        return out
    x = (np.concatenate(sets) >> U(16)).astype(np.uint32)
    cut = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for i in range(_SIZE):
        y = (x ^ _FLIP[i]) * _ODD[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y, cut)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        sets = shingle_sets(Words(batch.column("text").to_pylist()), WORDS)
        sizes = np.array([len(s) for s in sets], np.int64)
        signature = [None] * len(sets)
        full = np.flatnonzero(sizes)
        for i, row in zip(full, _signatures([sets[i] for i in full]), strict=True):
            signature[i] = row.astype("<u4").tobytes()
        # Sums of two mixes over the set: a key of 128 bits that doesn't depend on order.
        with np.errstate(over="ignore"):
            low = np.array([s.sum(dtype=U) for s in sets], U).view(np.int64)
            high = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(low), pa.array(high), pa.array(signature, pa.binary())], ["doc_id", "n_shingles", "low", "high", "signature"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and order: the key of its first DEPTH values."""
    for batch in given_back(batches):
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            values = _matrix(part.column("signature"))
            doc = part.column("doc_id").to_numpy()
            for tree in range(TREES):
                key = _prefix(values, tree, DEPTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), tree, np.int32)), pa.array(key), pa.array(doc)], ["tree", "region", "doc_id"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, _SIZE)


def _prefix(values: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """A hash of the first `depth` values of an order; orders are the signature rotated by DEPTH places a tree."""
    with np.errstate(over="ignore"):
        out = np.full(len(values), tree + 1, U)
        for i in range(depth):
            out = mix(out * U(31) + values[:, (tree * DEPTH + i) % _SIZE].astype(U))
    return out.view(np.int64)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of regions get their block: the deeper prefix that the region's size asks for. Also the signature's low bytes, and
    the order by the two values after that prefix."""
    for batch in given_back(batches):
        values = _matrix(batch.column("signature"))
        tree, size, region, doc = (batch.column(c).to_numpy() for c in ("tree", "n", "region", "doc_id"))
        depth = np.where(size > REGION, np.minimum(24, DEPTH + 2 * np.ceil(np.log2(np.maximum(size, 1) / REGION)).astype(int)), DEPTH)
        block, order = region.copy(), np.zeros(len(doc), np.int64)
        for t in np.unique(tree):
            own = np.flatnonzero(tree == t)
            for d in np.unique(depth[own]):
                at = own[depth[own] == d]
                if d > DEPTH:
                    block[at] = _prefix(values[at], int(t), int(d))
                next_ = values[at][:, (t * DEPTH + d + np.arange(2)) % _SIZE].astype(U)
                order[at] = (((next_[:, 0] << U(32)) | next_[:, 1]) >> U(1)).astype(np.int64)
        low = np.ascontiguousarray(values.astype(np.uint8)).tobytes()
        short = [low[i : i + _SIZE] for i in range(0, len(low), _SIZE)]
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(block), pa.array(np.zeros(len(doc), np.int64)), pa.array(order), pa.array(doc), pa.array(short, pa.binary())], ["tree", "block", "salt", "deeper", "doc_id", "low"])


def _parted(blocks: DataFrame, in_blocks) -> DataFrame:
    """Blocks of over PART documents dealt over salts, and as blocks of their own the leaders of all their salts."""
    done, rest, level = None, blocks, 0
    while True:
        large = written(rest.groupBy("tree", "block").agg(F.count("*").alias("n")).filter(F.col("n") > PART))
        if large.isEmpty():
            return done.unionByName(rest) if done else rest
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(level)), F.ceil(F.col("n") / PART)) + 1, F.lit(0))
        # Each level's salts stand apart from those of the others.
        dealt = written(rest.join(large, ["tree", "block"], "left").withColumn("salt", F.when(F.col("n").isNull(), F.lit(-level)).otherwise(salt + level * (1 << 40))).drop("n"))
        done = done.unionByName(dealt) if done else dealt
        salted = dealt.filter("salt > 0")
        rest = written(in_blocks(salted).mapInArrow(_leaders, blocks.schema))
        level += 1
        if rest.count() > 0.9 * salted.count():  # leaders of leaders would hardly be fewer: their blocks stay whole
            return done.unionByName(rest)


def _proposals(low: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each row of a block with the leader it resembles most, and the leaders: rows that are near none."""
    a, b = [], []
    leaders, led = np.zeros(16, np.int64), 1
    for i in range(1, len(low)):
        agree = (low[leaders[:led]] == low[i]).sum(axis=1)
        best = int(np.argmax(agree))
        if agree[best] >= MAYBE * _SIZE:
            a.append(i)
            b.append(int(leaders[best]))
        if agree[best] < NEAR * _SIZE:
            if led == len(leaders):
                leaders = np.concatenate([leaders, leaders])
            leaders[led] = i
            led += 1
    return a, b, leaders[:led].tolist()


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["tree", "block", "salt"]):
        low = _low(table)
        at = [s + k for s, e in zip(*_blocks_of(table), strict=True) for k in _proposals(low[s:e])[2]]
        yield from table.take(pa.array(at, pa.int64())).to_batches()


def _blocks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tree, block, salt = (table.column(c).to_numpy() for c in ("tree", "block", "salt"))
    change = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0) | (np.diff(salt) != 0)) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(tree)]])


def _low(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, _SIZE)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["tree", "block", "salt"]):
        doc, low = table.column("doc_id").to_numpy(), _low(table)
        begin, end = _blocks_of(table)
        # Blocks of two are most of all: at once.
        two = begin[end - begin == 2]
        keep = (low[two] == low[two + 1]).mean(axis=1) >= MAYBE if len(two) else np.zeros(0, bool)
        place_a, place_b = [two[keep]], [two[keep] + 1]
        for s, e in zip(begin[end - begin > 2], end[end - begin > 2], strict=True):
            x, y, _ = _proposals(low[s:e])
            place_a.append(np.array(x, np.int64) + s)
            place_b.append(np.array(y, np.int64) + s)
        x, y = np.concatenate(place_a), np.concatenate(place_b)
        agree = (low[x] == low[y]).sum(axis=1).astype(np.int64)
        pairs = np.unique(np.stack([np.maximum(doc[x], doc[y]), np.minimum(doc[x], doc[y]), agree], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32))], ["a", "b", "agree"])


def _linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Two sorted sets share PERCENT of their union."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum()) if len(q) else 0
    return both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between documents of one block that are of different components so far."""
    for table in runs(batches, ["tree", "block", "salt"]):
        doc, low, group, sets = table.column("doc_id").to_numpy(), _low(table), table.column("component").to_numpy().copy(), table.column("shingles")
        a, b = [], []
        for s, e in zip(*_blocks_of(table), strict=True):
            own, lows = group[s:e], low[s:e]
            if (own == own[0]).all():
                continue
            full = [np.frombuffer(x, U) for x in sets[int(s) : int(e)].to_pylist()]
            for i in range(1, len(own)):
                other = np.flatnonzero(own[:i] != own[i])
                if not len(other):
                    continue
                agree = (lows[other] == lows[i]).sum(axis=1)
                tried, agree = other[agree >= MAYBE * _SIZE], agree[agree >= MAYBE * _SIZE]
                for j in tried[np.argsort(-agree, kind="stable")]:
                    if own[i] != own[j] and _linked(full[i], full[j]):
                        a.append(doc[s + i])
                        b.append(doc[s + j])
                        own[own == own[j]] = own[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        sets = shingle_sets(Words(batch.column("text").to_pylist()), WORDS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "left", 4_000_000):
        ok = [_linked(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        sets = [np.zeros(0, U), *shingle_sets(Words(batch.column("text").to_pylist()), WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles that many documents of a sample hold: at most MOST_FREQUENT, the most frequent of all."""
    share = min(1.0, max(SAMPLE, LEAST_SAMPLE / max(1, rows.count())))
    counts = rows.sample(share, seed=1).mapInArrow(_listed, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    return found.column("shingle").to_numpy().view(U)


def _sampled(frequent):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (shingle, doc_id, need) for each shingle of SCREEN parts of all that isn't frequent, of each document. need says
        how many of them another document must hold: a set that is linked with this one lacks at most 25 % of it. One
        that needs none has a row more, whether or not it has any."""
        known = np.sort(frequent.value)
        for batch in chunks(batches, "text"):
            sets = shingle_sets(Words(batch.column("text").to_pylist()), WORDS)
            picked, needs = [], []
            for own, doc in zip(sets, batch.column("doc_id").to_pylist(), strict=True):
                mine = own[mix(own) < SCREEN]
                if len(known):
                    mine = mine[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] != mine]
                needs.append(len(mine) - (len(own) - -(-PERCENT * len(own) // 100)))
                picked.append(mine.view(np.int64) if needs[-1] > 0 or not len(own) else np.append(mine.view(np.int64), doc))
            of = np.repeat(np.arange(len(sets)), [len(x) for x in picked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked)), batch.column("doc_id").take(pa.array(of)), pa.array(np.array(needs, np.int32)[of])], ["shingle", "doc_id", "need"])

    return sampled


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles in which documents of several components meet, and those of documents that need none."""
    for table in runs(batches, ["shingle"]):
        shingle, component, need = (table.column(c).to_numpy() for c in ("shingle", "component", "need"))
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        group = np.cumsum(new) - 1
        several = np.zeros(int(group[-1]) + 1, bool)
        several[group[component != component[new][group]]] = True
        yield from table.select(["doc_id", "need"]).filter(pa.array(several[group] | (need <= 0))).to_batches()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set."""
    for batch in chunks(batches, "shingles"):
        sets = batch.column("shingles").to_pylist()
        sizes = np.array([len(x) // 8 for x in sets], np.int32)
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), batch.column("doc_id").take(at), pa.array(sizes).take(at), batch.column("component").take(at)], ["shingle", "doc_id", "n", "component"])


def _screened(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The doc_id of every document that may be linked with one of another component, by a part of its shingles."""
    spark = rows.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(rows))
    rows, schema = rows.filter("doc_id IS NOT NULL"), "shingle long, doc_id long, need int"
    # Most documents are components by themselves: the others alone are joined with theirs. Other rows of a class are dropped.
    others = Ids(rows.select("doc_id").join(classes.filter("component = doc_id"), "doc_id", "left_anti"))
    alone = others.mapped(rows, _sampled(frequent), schema, False).withColumn("component", F.col("doc_id"))
    joined = others.mapped(rows, _sampled(frequent), schema).join(classes, "doc_id")
    places = alone.unionByName(joined).repartition(partitions(spark), "shingle").sortWithinPartitions("shingle")
    met = places.mapInArrow(_met, "doc_id long, need int").groupBy("doc_id", "need").agg(F.count("*").alias("met"))
    return written(met.filter(F.col("met") >= F.col("need")).select("doc_id").distinct())


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) * SIZE_CLASSES).cast("int")


def _in_cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (shingle, size, doc_id, n, component, rest) of both sides in cells (shingle, size, a_part, b_part): those of one shingle
    and size that are of different components meet in one cell.

    A shingle's rows of one size fall into parts of about SIDE rows. A component with more rows there has parts of its own,
    which don't meet one another: so what a large group of near copies meets is only what else holds the shingle."""
    both = left.select("shingle", "size", "component", F.lit(1).alias("seeks"), F.lit(0).alias("stands")).unionByName(right.select("shingle", "size", "component", F.lit(0).alias("seeks"), F.lit(1).alias("stands")))
    each = both.groupBy("shingle", "size", "component").agg(F.greatest(F.sum("seeks"), F.sum("stands")).alias("n"))
    # Null is the own of all components that share their parts. It comes first.
    own = F.when(F.col("n") > SIDE, F.col("component"))
    cut = each.groupBy("shingle", "size", own.alias("own")).agg(F.ceil(F.sum("n") / SIDE).alias("parts"))
    group = Window.partitionBy("shingle", "size")
    cut = cut.withColumns({"first": F.coalesce(F.sum("parts").over(group.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("parts").over(group)})
    owns = F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", F.struct("first", "parts"))))
    cells = written(cut.filter("total > 1").groupBy("shingle", "size").agg(F.max("total").alias("total"), F.max(F.when(F.col("own").isNull(), F.col("parts"))).alias("common"), F.map_from_entries(owns).alias("owns")))

    def side(rows: DataFrame, to: str, other: str) -> DataFrame:
        rows = rows.join(cells, ["shingle", "size"], "left").withColumn("own", F.try_element_at("owns", F.col("component")))
        first, last = F.col("own.first"), F.col("own.first") + F.col("own.parts") - 1
        part = F.coalesce(first + F.pmod(F.xxhash64("doc_id"), F.col("own.parts")), F.pmod(F.xxhash64("doc_id"), F.col("common")), F.lit(0))
        all_ = F.sequence(F.lit(0).cast("long"), F.coalesce("total", F.lit(1)).cast("long") - 1)
        met = F.when(first.isNull(), all_).otherwise(F.filter(all_, lambda i: ~i.between(first, last)))
        columns = [F.col(c).alias(f"{to}_{c}") for c in ("doc_id", "n", "component", "rest")]
        return rows.select("shingle", "size", part.cast("long").alias(f"{to}_part"), F.explode(met).alias(f"{other}_part"), *columns)

    return side(left, "a", "b"), side(right, "b", "a")


def _missed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, by the documents of classes (doc_id, component): every pair
    that is linked is among them.

    Of the documents that _screened leaves, the shingles that several components hold are put in one order, the rarest
    first. Two sets have no more in common than the first shingle that they share and what each has after it; what
    a document has there says how large the other may be. So a shingle's rows meet by classes of size, and rows that leave no
    room for a link with any size meet none."""
    screened = _screened(rows, classes)
    listed = _sets_of(screened, rows).join(classes, "doc_id").mapInArrow(_each, "shingle long, doc_id long, n int, component long")
    counts = listed.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("least"), F.max("component").alias("greatest")).filter("least < greatest")
    # One row a shingle on the right, so a hot shingle can be split on the left.
    shared = listed.join(counts.select("shingle", "held"), "shingle")
    own = Window.partitionBy("doc_id")
    rest = F.count("*").over(own) - F.row_number().over(own.orderBy("held", "shingle")) + 1
    # Linked sets of n and m shingles share PERCENT of their union: (100 + PERCENT) * shared >= PERCENT * (n + m).
    most = F.least(F.floor(100 * F.col("n") / PERCENT), F.floor((100 + PERCENT) * F.col("rest") / PERCENT) - F.col("n"))
    placed = shared.withColumn("rest", rest).withColumns({"low": F.ceil(PERCENT * F.col("n") / 100), "most": most})
    placed = written(placed.filter("most >= low").select("shingle", "doc_id", "n", "component", "rest", "low", "most"))
    # The greater set, or one as great, looks for the other.
    left = placed.withColumn("size", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.least("n", "most")))))
    right = placed.withColumn("size", _size_class(F.col("n")))
    a, b = _in_cells(left, right)
    room = (100 + PERCENT) * F.least("a_rest", "b_rest") >= PERCENT * (F.col("a_n") + F.col("b_n"))
    both = a.join(b, ["shingle", "size", "a_part", "b_part"]).filter((F.col("a_component") != F.col("b_component")) & (F.col("a_n") >= F.col("b_n")) & room)
    return written(both.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct())


def _sets_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents among ids, and of some others. Texts are read where they lie."""
    return written(Ids(ids).mapped(rows, _sets, "doc_id long, shingles binary"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked by their full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return written(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long").distinct())


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links of similarity 0.75 or more, and kept marks it. A null or
    empty text has no shingles and is linked with nothing; a text of one to four words is one shingle. Rows that repeat
    a doc_id with the same text are one document, which is kept once for each row; a null doc_id is kept alone, with a
    null component. Extra columns are ignored; an empty table gives no rows.
    """
    rows = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    signed = written(rows.mapInArrow(_signed, "doc_id long, n_shingles long, low long, high long, signature binary"))
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("doc_id")))
    own = classes.join(signed.select("doc_id", "signature", "n_shingles", "low", "high"), ["doc_id", "n_shingles", "low", "high"]).groupBy("doc_id").agg(F.min("signature").alias("signature"))

    orders = own.mapInArrow(_orders, "tree int, region long, doc_id long")
    regions = orders.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter("n > 1")
    met = written(orders.join(regions, ["tree", "region"]).select("tree", "region", "doc_id", "n", "head"))
    n = partitions(documents.sparkSession)
    in_blocks = lambda table: table.repartition(n, "tree", "block", "salt").sortWithinPartitions("tree", "block", "salt", "deeper", "doc_id")

    blocks = met.join(own, "doc_id").select("tree", "region", "doc_id", "n", "signature").mapInArrow(_blocked, "tree int, block long, salt long, deeper long, doc_id long, low binary")
    blocks = _parted(written(blocks), in_blocks)

    # In large regions, which blocks divide, every document is also held against the region's first.
    stars = met.filter((F.col("n") > REGION) & (F.col("head") < F.col("doc_id"))).select(F.col("doc_id").alias("a"), F.col("head").alias("b"), F.lit(-1).alias("agree")).distinct()
    proposals = written(in_blocks(blocks).mapInArrow(_pairs, "a long, b long, agree int").unionByName(stars))
    best = written(proposals.groupBy("a").agg(F.max_by("b", "agree").alias("b")))
    links = _confirm(best, _sets_of(best.select(F.explode(F.array("a", "b")).alias("doc_id")), rows))
    found = written(components(links))

    # Blocks that hold documents of more than one component, and stars between components.
    named = found.withColumnRenamed("node", "doc_id")
    rest = written(blocks.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    several = rest.groupBy("tree", "block", "salt").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).filter("least < greatest").select("tree", "block", "salt")
    rest = written(rest.join(several, ["tree", "block", "salt"], "left_semi"))
    of = [found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component")) for side in ("a", "b")]
    apart = stars.join(of[0], "a", "left").join(of[1], "b", "left").filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b"))
    apart = written(apart.select("a", "b").join(best, ["a", "b"], "left_anti"))
    sets = _sets_of(rest.select("doc_id").unionByName(apart.select(F.explode(F.array("a", "b")).alias("doc_id"))), rows)
    between = written(in_blocks(rest.join(sets, "doc_id")).mapInArrow(_between, "a long, b long"))
    more = between.unionByName(_confirm(apart, sets))
    if not more.isEmpty():
        found = written(components(links.unionByName(more)))

    # What no order has brought together.
    placed = classes.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = written(placed)
    missed = _missed(rows, placed)
    more = _confirm(missed, _sets_of(missed.select(F.explode(F.array("a", "b")).alias("doc_id")), rows))
    if not more.isEmpty():
        # These links join components, so only components need to be joined.
        ends = [placed.select(F.col("doc_id").alias(side), F.col("component").alias(f"{side}_component")) for side in ("a", "b")]
        joined = components(more.join(ends[0], "a").join(ends[1], "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
        placed = placed.join(joined, "component", "left").select("doc_id", F.coalesce("least", "component").alias("component"))

    classes = classes.join(placed, "doc_id").select("n_shingles", "low", "high", "component")
    # The join has one row a class on its right, so a hot class can be split on its left.
    return signed.select("doc_id", "n_shingles", "low", "high").join(classes, ["n_shingles", "low", "high"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents without those that are near-duplicates of one that stays."""
    return without(documents, written(near_duplicates(documents).filter("NOT kept").select("doc_id")))
