"""Spelling variants: words at distance one, by a self-join of the vocabulary's trie with active-node sets.

Two words at distance one, of which the shorter has m letters, share their first m // 2 letters or their last ones. So
the trie and that of the reversed words are partitioned by prefixes of this length, and every partition is joined in
itself, level by level:

1. Active at distance nought are equal nodes. Each gives, at its own depth, the new active nodes at distance one:
   its children with one another (a letter replaced), and each of its children with itself (a letter inserted).
2. Active nodes at distance one are propagated to children with equal letters in both places; a pair that is left when
   the words end is a pair of terminals. A letter inserted beside equal ones counts where the words part, once.
3. A partition of over MOST words is cut at its root, as often as need be. The active nodes that a cut parts have no
   distance left, so they are carried by the word without the letter at the cut, of which an alphabet's worth exist.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, partitions, runs, text_bytes, written

#: Words of a partition of the trie that one task joins in itself; larger ones are cut.
MOST = 50_000
#: Different words that a task counts before it hands their counts on.
HELD = 300_000
#: Letters beyond ASCII that words may have, next to those of ASCII, as fixed by the contract: U+00C0 to U+00FF.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _counts(dropped: int | None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in chunks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # Letters are one byte each in this code; what it lacks becomes a question mark, which parts words.
                words = text.decode().encode("latin-1", "replace").translate(_LETTERS).split()
                total.update(words)
                if dropped and doc_id is not None:
                    _drop(total, words, doc_id, dropped)
                if len(total) > HELD:
                    yield out()
        yield out()

    return counted


def _drop(total: Counter[bytes], words: list[bytes], doc_id: int, every: int) -> None:
    """Take a letter out of the words of a document whose crc32 with its doc_id is divisible by `every`."""
    start, different = zlib.crc32(b"%d:" % doc_id), list(set(words))
    hashes = [zlib.crc32(w if w.isascii() else _utf8(w), start) for w in different]
    changed = [(w, h) for w, h in zip(different, hashes, strict=True) if not h % every]
    own = Counter(words) if len(words) > 5000 else None
    for word, h in changed:
        n, at = own[word] if own else words.count(word), h % len(word)
        total[word] -= n
        total[word[:at] + word[at + 1 :]] += n


def counted(documents: DataFrame, least_letters: int = 5, least_times: int = 3, dropped: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with least_letters letters or more that occur least_times or more.

    Words are longest runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered. With `dropped`, a word whose
    crc32 after its doc_id is divisible by it loses a letter before it is counted. A null text has no words; in a row
    without a doc_id no letter is dropped. Repeated rows count as often as they stand there; extra columns are ignored.
    """
    rows = narrow(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    counts = rows.mapInArrow(_counts(dropped), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.length("word") >= least_letters) & (F.col("n") >= least_times))


class _Trie:
    """The trie of sorted words of one length below a given depth. A node is the first of its words, numbered by level."""

    def __init__(self, words: list[str], length: int):
        self.letters = np.array(words, f"U{max(1, length)}").view(np.uint32).reshape(len(words), max(1, length))
        # How many leading letters each word shares with the one before.
        differ = self.letters[1:] != self.letters[:-1]
        self.shared = np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), length)]) if len(words) else np.zeros(0, int)

    def nodes(self, depth: int) -> np.ndarray:
        return np.flatnonzero(self.shared < depth)

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The parent, by its number at `depth`, and the letter of each node one deeper, in order of both."""
        below = self.nodes(depth + 1)
        return np.searchsorted(self.nodes(depth), below, "right") - 1, self.letters[below, depth].astype(np.int64)


_Children = tuple[np.ndarray, np.ndarray]


def _each_child(nodes: np.ndarray, children: _Children) -> tuple[np.ndarray, np.ndarray]:
    """For all children of the given nodes, the place of their parent among these and the child."""
    low, high = np.searchsorted(children[0], nodes, "left"), np.searchsorted(children[0], nodes, "right")
    n = high - low
    at = np.repeat(np.arange(len(nodes)), n)
    return at, np.arange(len(at)) + np.repeat(low - (np.cumsum(n) - n), n)


def _propagated(u: np.ndarray, v: np.ndarray, of_u: _Children, of_v: _Children, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Active pairs of nodes one level on: children with equal letters, but those of the letter `but`, if given."""
    at, child = _each_child(u, of_u)
    letter = of_u[1][child]
    if but is not None:
        keep = letter != but[at]
        at, child, letter = at[keep], child[keep], letter[keep]
    keys = (of_v[0].astype(np.int64) << 21) | of_v[1]
    wanted = (v[at].astype(np.int64) << 21) | letter
    place = np.searchsorted(keys, wanted)
    there = place < len(keys)
    there[there] = keys[place[there]] == wanted[there]
    return child[there], place[there]


def _replaced(trie: _Trie, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of terminals with one letter replaced beyond `depth`."""
    u = v = np.zeros(0, np.int64)
    for d in range(depth, length):
        children = trie.children(d)
        u, v = _propagated(u, v, children, children)
        # New: each child with its later siblings.
        number = np.arange(len(children[0]))
        last = np.searchsorted(children[0], children[0], "right")
        n = last - number - 1
        left = np.repeat(number, n)
        right = np.arange(len(left)) + np.repeat(number + 1 - (np.cumsum(n) - n), n)
        u, v = np.concatenate([u, left]), np.concatenate([v, right])
    return u, v


def _inserted(long: _Trie, short: _Trie, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of terminals of which the first has a letter more, inserted beyond `depth`."""
    roots = [t.letters[t.nodes(depth), :depth] for t in (long, short)]
    keys = [np.ascontiguousarray(r.astype(">u4")).view(f"S{4 * depth}").ravel() if depth else np.zeros(min(1, len(r)), "S1") for r in roots]
    _, same_u, same_v = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    u = v = new_u = new_v = letter = np.zeros(0, np.int64)
    for d in range(depth, length + 1):
        of_long = long.children(d)
        if d > depth:
            of_short = short.children(d - 1)
            old, fresh = _propagated(u, v, of_long, of_short), _propagated(new_u, new_v, of_long, of_short, but=letter)
            u, v = (np.concatenate(x) for x in zip(old, fresh, strict=True))
        at, new_u = _each_child(same_u, of_long)
        new_v, letter = same_v[at], of_long[1][new_u]
        if d < length:
            same_u, same_v = _propagated(same_u, same_v, of_long, short.children(d))
    return np.concatenate([u, new_u]), np.concatenate([v, new_v])


_PAIRS = "word string, n long, near string, near_n long"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both orders of all pairs at distance one within whole partitions of the trie."""
    for table in runs(batches, ["back", "tag", "depth", "prefix"]):
        back, tag, depth = (table.column(c).to_numpy() for c in ("back", "tag", "depth"))
        change = np.flatnonzero((np.diff(back) != 0) | (np.diff(tag) != 0) | (np.diff(depth) != 0)) + 1
        for s, e in zip([0, *change], [*change, len(tag)], strict=True):
            words, n = np.array(table.column("word")[int(s) : int(e)].to_pylist(), object), table.column("n")[int(s) : int(e)].to_numpy()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            length, half = int(tag[s]), int(tag[s]) // 2
            places = [np.flatnonzero(sizes == size) for size in (length, length + 1)]
            short, long = (_Trie(words[p].tolist(), size) for p, size in zip(places, (length, length + 1), strict=True))
            for at, tries, (u, v) in (((0, 0), (short, short), _replaced(short, int(depth[s]), length)), ((1, 0), (long, short), _inserted(long, short, int(depth[s]), length))):
                if back[s] and len(u):
                    # Words that begin alike, too, have met in the trie of words as they are.
                    ends = [t.letters[x, t.letters.shape[1] - half :] for t, x in zip(tries, (u, v), strict=True)]
                    apart = (ends[0] != ends[1]).any(axis=1)
                    u, v = u[apart], v[apart]
                a, b = places[at[0]][u], places[at[1]][v]
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
                own = words[a], words[b]
                if back[s]:
                    own = [[w[::-1] for w in x] for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(n[a]), pa.array(own[1], pa.string()), pa.array(n[b])], _PAIRS.replace(",", "").split()[0::2])


def _parts(vocabulary: DataFrame) -> DataFrame:
    """Each word in its partitions of both tries (back, tag, depth, prefix): with words of its length and one more (tag), and
    with words of its length and one less."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("w")), F.struct(F.lit(1).alias("back"), F.reverse("word").alias("w"))))
    rows = vocabulary.select(sides.alias("side"), "n").select("side.back", F.col("side.w").alias("word"), "n")
    rows = rows.select("back", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("tag"), "word", "n")
    return rows.select("back", "tag", F.expr("tag DIV 2").cast("int").alias("depth"), F.expr("substring(word, 1, CAST(tag DIV 2 AS INT))").alias("prefix"), "word", "n")


def _cut(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Partitions of `most` words or fewer, and the pairs of words that cuts have parted."""
    parted = None
    by = ["back", "tag", "depth", "prefix"]
    while True:
        # What a cut can't part is an alphabet's worth of words.
        large = written(rows.groupBy(*by).agg(F.count("*").alias("rows")).filter((F.col("rows") > most) & (F.col("depth") < F.col("tag"))).drop("rows"))
        if large.isEmpty():
            return rows, parted
        hot = written(rows.join(large, by, "left_semi"))
        without = F.expr("concat(substring(word, 1, depth), substring(word, depth + 2, length(word)))")
        keyed = hot.withColumns({"key": without, "letter": F.expr("substring(word, depth + 1, 1)"), "size": F.length("word")}).drop("prefix")
        one, other = keyed.select("back", "tag", "depth", "key", "word", "n", "letter", "size"), keyed.filter("size = tag")
        replaced = other.select("back", "tag", "depth", "key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("near_letter"))
        inserted = other.select("back", "tag", "depth", F.col("word").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("near_letter"))
        on = ["back", "tag", "depth", "key"]
        half = F.expr("CAST(tag DIV 2 AS INT)")
        # Words that are alike after the cut have not been parted; those that begin alike have met in the other trie.
        apart = (F.col("letter") != F.col("near_letter")) & ~((F.col("back") == 1) & (F.right("word", half) == F.right("near", half)))
        seen = lambda c: F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
        pair = lambda rows, to: rows.join(to, on).filter(apart).select(seen("word"), "n", seen("near"), "near_n")
        longer = pair(one.filter("size = tag + 1"), inserted)
        met = written(pair(one.filter("size = tag"), replaced).unionByName(longer).unionByName(longer.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n")))
        parted = met if parted is None else parted.unionByName(met)
        deeper = hot.withColumn("depth", F.col("depth") + 1).withColumn("prefix", F.expr("substring(word, 1, depth)"))
        rows = written(rows.join(large, by, "left_anti").unionByName(deeper))


def pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both orders of all pairs of different words of (word, n) that are one inserted, deleted or
    replaced letter apart. A word must stand there once; a null or empty one is left out."""
    n = partitions(vocabulary.sparkSession)
    rows, parted = _cut(written(_parts(vocabulary.filter("length(word) > 0"))), MOST)
    dealt = rows.repartition(n, "back", "tag", "depth", "prefix").sortWithinPartitions("back", "tag", "depth", "prefix", "word")
    found = dealt.mapInArrow(_joined, _PAIRS)
    return found.unionByName(parted) if parted is not None else found


def forms(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """Of words (word, n): word, form, root, n, n_near, form_n.

    form is the word at distance one of largest n (ties: smallest in code-point order), if that n is at least `times` that
    of the word (form_n), else null; n_near counts the words at distance one. root is where forms lead from word
    to word; without a form it is the word itself. `times` must be over 1, so that forms lead to an end. An empty
    vocabulary gives no rows.
    """
    if times <= 1:
        raise ValueError("times must be over 1")
    vocabulary = written(narrow(vocabulary, word="word", n="n"))
    best = pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    strong = -F.col("best.minus") >= times * F.col("n")
    near = written(best.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")))
    # Pointers are doubled until each is a root: as many rounds as the longest way of forms has binary digits.
    to = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    near = near.join(to, "word", "left")
    return vocabulary.join(near, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
