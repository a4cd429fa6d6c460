"""Best-fit packing by bin completion, a branch-and-bound search.

Only the lengths matter to the packing, and there are at most `capacity` of them: Spark counts the pieces of each
length, the search runs on that histogram (at most `capacity` numbers, whatever the corpus), and its answer is a list of
patterns with a number of copies each. Every piece then finds its sequence from its length and its rank among the pieces
of that length, which Spark numbers in salted groups.

The search fills one sequence after another about the largest length left. Best fit gives the first answer, the
incumbent. Where it needs more sequences than a lower bound of all lengths proves necessary, the undominated fillings of
each sequence are tried, fullest first; a branch ends where its waste so far, with the waste that the bound proves for
the lengths left, is no less than the incumbent's, or where the same lengths have been left before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, given_back, narrow, partitions, text_bytes, written
from .tokens import encoder

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Lengths that are tried in the search for fewer sequences than best fit needs: some ten seconds on the driver, at most.
EFFORT = 2_000_000
#: Lengths of a sequence beyond which the search ends, as if its steps were used up.
DEEPEST = 500


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing can do without. For each threshold t: lengths over capacity - t have no length
    of t or more beside them, lengths over half stand apart, and what these leave must hold the lengths from t to half."""
    half = capacity // 2
    n = np.cumsum(counts[::-1])[::-1]  # how many are of a length or longer
    total = np.cumsum((counts * np.arange(len(counts)))[::-1])[::-1]
    n, total = np.append(n, 0), np.append(total, 0)
    t = np.concatenate([[1], np.flatnonzero(counts[: half + 1])])
    alone, apart = n[capacity - t + 1], n[half + 1] - n[capacity - t + 1]
    apart, alone = np.maximum(apart, 0), np.minimum(alone, n[half + 1])
    room = apart * capacity - (total[half + 1] - total[np.maximum(capacity - t, half) + 1])
    small = total[np.minimum(t, half + 1)] - total[half + 1]
    return int((n[half + 1] + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, copies): again and again the largest length left, with the one or two that fill it best, else with the
    largest that fits, and so on; a filling is used as often as its lengths last."""
    counts, out = counts.copy(), []
    lengths = np.flatnonzero(counts)
    while len(lengths):
        below = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))  # the largest length at most so long
        while len(lengths) and counts[lengths[-1]]:
            items, used = [], Counter()

            def take(x: int) -> None:
                items.append(x)
                used[x] += 1

            take(int(lengths[-1]))
            space = capacity - items[0]
            while space > 0:
                first = lengths[: np.searchsorted(lengths, space, "right")][::-1]
                if not len(first):
                    break
                # Two that together leave the least space; of equals the one with the larger length.
                second = below[space - first]
                pair = None
                for k in np.argsort(-(first + second), kind="stable")[:16]:
                    x, y = int(first[k]), int(second[k])
                    if counts[x] - used[x] > (x == y) and (not y or counts[y] - used[y] > 0):
                        pair = (x, y)
                        break
                if pair and sum(pair) == space:
                    for x in pair:
                        if x:
                            take(x)
                    break
                x = int(below[space])
                while x and counts[x] - used[x] <= 0:
                    x = int(below[x - 1])
                if not x:
                    break
                take(x)
                space -= x
            copies = min(int(counts[x]) // k for x, k in used.items())
            for x, k in used.items():
                counts[x] -= k * copies
            out.append((items, copies))
            if any(not counts[x] for x in used):
                break
        lengths = lengths[counts[lengths] > 0]
    return out


def _dominated(items: list[int], slack: int, counts: np.ndarray, used: Counter) -> bool:
    """Whether a length left over could stand in the place of some of the items and fill the sequence no less: whatever
    they fill elsewhere could then be filled with them in its place."""
    sums = {0: 0}  # a sum of items, and the number of them
    for x in items:
        for s, k in list(sums.items()):
            sums[s + x] = max(sums.get(s + x, 0), k + 1)
    for s, k in sums.items():
        if s:
            low = s + 1 if k < 2 else s
            here = np.flatnonzero(counts[low : s + slack + 1]) + low
            if any(counts[y] - used[y] > 0 for y in here.tolist()):
                return True
    return False


def _reached(lengths: list[int], capacity: int) -> list[int]:
    """For each place in `lengths`, as bits, the sums up to capacity that those from there on make, each as often as wanted."""
    whole, out = (1 << (capacity + 1)) - 1, [1]
    for x in reversed(lengths):
        sums, step = out[-1], x
        while step <= capacity:
            sums |= (sums << step) & whole
            step *= 2
        out.append(sums)
    return out[::-1]


def fillings(counts: np.ndarray, capacity: int, most_waste: int, effort: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of the undominated sequences about the largest length that waste at most most_waste. Lengths after
    which no sum fills enough are left out. Each length that is tried takes one from effort, and none is made when it
    is used up."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    largest, order, have = lengths[0], [-x for x in lengths], counts.tolist()
    used, reached, most_waste = Counter([largest]), _reached(lengths, capacity), max(0, most_waste)

    def fills(at: int, space: int) -> bool:
        low = max(0, space - most_waste)
        return bool(reached[at] >> low & ((1 << (space - low + 1)) - 1))

    def extend(at: int, space: int, items: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        if len(items) > DEEPEST:
            effort[0] = 0
        if effort[0] <= 0:
            return
        grown = False
        for k in range(max(at, bisect_left(order, -space)), len(lengths)):
            x = lengths[k]
            effort[0] -= 1
            if have[x] - used[x] > 0:
                grown = True
                if not fills(k, space - x):
                    continue
                used[x] += 1
                items.append(x)
                yield from extend(k, space - x, items)
                items.pop()
                used[x] -= 1
        if not grown and space <= most_waste and effort[0] > 0 and not _dominated(items, space, counts, used):
            yield space, (largest, *items)

    yield from extend(0, capacity - largest, [])


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[tuple[list[int], int]]:
    """(lengths, copies): sequences that hold every counted piece, as few as the search finds.

    The result is the least number wherever the incumbent meets the lower bound or the search ends by itself. It stops
    after `effort` steps, or where a sequence has over DEEPEST lengths: bounds on the driver's time that do not depend on
    the corpus. It then keeps the incumbent.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    best = best_fit(counts, capacity)
    best_n, proven = sum(n for _, n in best), lower_bound(counts, capacity)
    left, seen, nodes = [effort], set(), 0

    def options(now: np.ndarray, done: int) -> list[tuple[int, tuple[int, ...]]]:
        # Waste that a better packing may still have: its sequences' space less all that is to be packed.
        spare = (best_n - 1 - done) * capacity - int((now * np.arange(capacity + 1)).sum())
        return sorted(fillings(now, capacity, spare, left), key=lambda f: (f[0], len(f[1])))

    # Depth first with a stack of its own: (lengths left, sequences so far, fillings to try, what led here).
    stack = [(counts, 0, iter(options(counts, 0)), None)] if best_n > proven else []
    while stack and best_n > proven and left[0] > 0:
        now, done, tries, _ = stack[-1]
        step = next(tries, None)
        if step is None:
            stack.pop()
            continue
        used = Counter(step[1])
        after = now.copy()
        for x, k in used.items():
            after[x] -= k
        n = done + 1
        path = (step[1], stack[-1][3])
        if not after.any():
            if n < best_n:
                best, best_n = [], n
                while path:
                    best.append((list(path[0]), 1))
                    path = path[1]
            continue
        key = after.tobytes()
        if n + lower_bound(after, capacity) >= best_n or key in seen:
            continue
        seen.add(key)
        # Best fit on what is left may end the search at once. It is costly: after the first nodes it is tried now and then.
        nodes += 1
        if nodes <= 64 or nodes % 16 == 0:
            rest = best_fit(after, capacity)
            if n + sum(c for _, c in rest) < best_n:
                best, best_n, back = list(rest), n + sum(c for _, c in rest), path
                while back:
                    best.append((list(back[0]), 1))
                    back = back[1]
            left[0] -= 20 * int((after > 0).sum())  # what it costs, in lengths tried
        left[0] -= 100
        stack.append((after, n, iter(options(after, n)), path))
    return best


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of `capacity`: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, "text"):
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), enc.ids(batch.column("text").to_pylist()), strict=True):
                ids = own.astype("<u4").tobytes() + end
                rows += [(doc, at // (4 * capacity), at // 4, len(part := ids[at : at + 4 * capacity]) // 4, zlib.crc32(part)) for at in range(0, len(ids), 4 * capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens; one row per piece.

    A null text counts as empty: a piece of one token. Repeated rows are pieces of their own. Equal lengths are
    interchangeable; among them, pieces are placed by doc_id and piece. Extra columns are ignored. An empty table
    gives no rows.
    """
    table = written(pieces(documents, capacity, tokenizer))
    salts = partitions(documents.sparkSession)
    table = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # At most capacity * salts rows.
    cells = table.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).select("length", "salt", "before")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}

    slots, following, sequence = [], dict.fromkeys(histogram, 0), 0
    for items, copies in patterns(histogram, capacity):
        offset = 0
        for length in items:
            slots.append((length, following[length], sequence, offset))
            following[length] += copies
            offset += length
        sequence += copies
    # Each pattern of best fit uses up a length or all but a few of it, and the search has at most EFFORT steps: the
    # slots are bounded, whatever the corpus.
    slots.sort()
    shared = documents.sparkSession.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 4))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, sequence, offset = shared.value.T
        key = (length << 44) + rank
        for batch in given_back(batches):
            own = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + own, "right") - 1
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = table.withColumn("number", number).join(cells, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, schema)
