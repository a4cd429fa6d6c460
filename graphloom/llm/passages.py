"""What both operators on repeated passages need: exact copies, runs of equal words, and results by document.

A passage is given by word positions in its document. Both operators look only among different texts: of equal texts
the least doc_id stands for all, and each other copy is reported as one passage, the whole text.

Texts are never shuffled but for the documents that take part in a match, which a bitmap of fixed size tells to the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ids, chunks, hot_keys, mean_share, narrow, partitions, runs, text_bytes, written
from .words import U, Words, mix

MIN_WORDS = 50
#: Words of a seed, and seeds from which the least is an anchor: every run of ANCHORED + GRAM - 1 words holds one.
GRAM = 8
ANCHORED = 24
LEAST_MIN_WORDS = ANCHORED + GRAM - 1
#: Words on either side of an anchor that a run about it may begin or end with, besides the prefix.
LEFT = ANCHORED - 1
STRETCH = "a long, a_place long, b long, b_place long, length long"
RESULT = "doc_id long, start_word long, n_words long, source_doc_id long, source_start_word long, n_equal long"


def rows_of(documents: DataFrame) -> DataFrame:
    """doc_id and text of the documents that have an id."""
    return narrow(documents, doc_id="doc_id", text="text").filter("doc_id IS NOT NULL").select("doc_id", text_bytes().alias("text"))


def copies_of(documents: DataFrame) -> DataFrame:
    """(doc_id, source_doc_id, n_words) of every document whose text a lesser source_doc_id has: the least that has it."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            keys = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(t.split()) for t in texts], pa.int64())], ["doc_id", "text_key", "n_words"])

    keys = written(rows_of(documents).mapInArrow(keyed, "doc_id long, text_key binary, n_words long"))
    least = written(keys.groupBy("text_key").agg(F.min("doc_id").alias("source_doc_id"), F.count("*").alias("rows")).filter("rows > 1"))
    # Texts of very many copies, at most two a partition, are few enough to broadcast: those copies stay where they lie.
    often = F.broadcast(least.filter(F.col("rows") > mean_share(keys.count(), documents.sparkSession)))
    few = keys.join(often.select("text_key"), "text_key", "left_anti").join(least, "text_key")
    return written(keys.join(often, "text_key").unionByName(few).filter("doc_id > source_doc_id").select("doc_id", "source_doc_id", "n_words").distinct())


def copied(copies: DataFrame, min_words: int) -> DataFrame:
    """The copies of at least min_words words as passages."""
    zero = F.lit(0).cast("long")
    return copies.filter(F.col("n_words") >= min_words).select("doc_id", zero.alias("start_word"), "n_words", "source_doc_id", zero.alias("source_start_word"), F.col("n_words").alias("n_equal"))


def distinct_texts(documents: DataFrame, copies: DataFrame, function, schema: str) -> DataFrame:
    """function over (doc_id, text) of the documents that are no copies. Only those that may be copies are shuffled."""
    ids, rows = Ids(copies), rows_of(documents)
    others = ids.rows(rows).join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    return ids.mapped(rows, function, schema, False).unionByName(others.mapInArrow(function, schema))


def _contexts(min_words: int):
    """Of each of a document's places the words about the prefix, as 4-byte hashes: those before it, nearest first, and
    those after it, up to LEFT of either."""
    keyed = min_words - LEFT

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text").to_pylist())
            short = words.hashes.astype("<u4")
            back = np.ascontiguousarray(short[::-1])
            near = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy()))
            flat = near.flatten()
            place, prefix = flat.field("place").to_numpy().astype(np.int64), flat.field("prefix").to_numpy()
            low, high, n = words.first[:-1][owner], words.first[1:][owner], len(short)
            # Rows that repeat a doc_id with another text have other suffixes.
            fits = np.flatnonzero(place + keyed <= high - low)
            fits = fits[words.run_hashes(low[fits] + place[fits], keyed).view(np.int64) == prefix[fits]]
            place, prefix, low, high, owner = (c[fits] for c in (place, prefix, low, high, owner))
            at = low + place
            before = [back[n - i : n - i + k].tobytes() for i, k in zip(at.tolist(), np.minimum(place, LEFT).tolist(), strict=True)]
            after = [short[i : i + k].tobytes() for i, k in zip((at + keyed).tolist(), np.minimum(high - at - keyed, LEFT).tolist(), strict=True)]
            docs = batch.column("doc_id").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(docs), pa.array(place.astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["prefix", "doc_id", "place", "before", "after"])

    return contexts


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of LEFT words, with zeros after their end, and how many words each has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(p.ljust(4 * LEFT, b"\0") for p in parts), "<u4").reshape(-1, LEFT), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _sums(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0 to LEFT words of each row."""
    out = np.zeros((len(words), LEFT + 1), U)
    with np.errstate(over="ignore"):
        for i in range(LEFT):
            out[:, i + 1] = mix(out[:, i] * U(31) + words[:, i].astype(U) + U(1))
    return out


def _intervals(min_words: int):
    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal stretches of suffixes that stand in order. What two neighbours' words have in common after the prefix parts
        them into intervals of suffixes that agree in `right` words or more; in each, those with the same LEFT - right words
        before the prefix hold one run of min_words words, and the least document's is the source of all others."""
        for table in runs(batches, ["prefix"]):
            prefix, doc, place, least, most = (table.column(c).to_numpy() for c in ("prefix", "doc_id", "place", "least", "most"))
            place = place.astype(np.int64)
            (before, n_before), (after, n_after) = _padded(table.column("before")), _padded(table.column("after"))
            common = np.minimum.accumulate(after[1:] == after[:-1], axis=1).sum(axis=1)
            common[prefix[1:] != prefix[:-1]] = -1
            sums = _sums(before)
            by_doc = np.lexsort((place, doc))
            source = np.full((len(doc), LEFT + 1), -1, np.int64)
            for left in range(LEFT + 1):
                right = LEFT - left
                interval = np.concatenate([[0], np.cumsum(common < right)]).astype(U)
                rows = by_doc[((n_before >= left) & (n_after >= right) & (least <= left) & (left <= most))[by_doc]]
                with np.errstate(over="ignore"):
                    key = mix(interval[rows] * U(0x9E3779B97F4A7C15) ^ sums[rows, left])
                order = np.argsort(key, kind="stable")
                first = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
                head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
                x, y = rows[order], rows[head]
                other = doc[y] < doc[x]
                source[x[other], left] = y[other]
            # Runs that follow one another and have one source are one stretch.
            flat = source.ravel()
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            new[:: LEFT + 1] = True
            start = np.flatnonzero(new)
            end = np.concatenate([start[1:], [len(flat)]])
            keep = flat[start] >= 0
            start, end = start[keep], end[keep]
            x, y, furthest = start // (LEFT + 1), flat[start], (end - 1) % (LEFT + 1)
            out = (doc[x], place[x] - furthest, doc[y], place[y] - furthest, end - start - 1 + min_words)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], STRETCH.replace(",", "").split()[0::2])

    return intervals


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of a prefix parted by what else a run about it must hold: those that begin at most half-way before the
    prefix have more words after it, the others more words before it; both make a longer prefix."""
    for batch in batches:
        (before, n_before), (after, n_after) = _padded(batch.column("before")), _padded(batch.column("after"))
        left, right = _sums(before), _sums(after)
        prefix, least, most = (batch.column(c).to_numpy() for c in ("prefix", "least", "most"))
        middle = (least + most) // 2
        for low, high in ((least, middle), (middle + 1, most)):
            at = np.flatnonzero((n_before >= low) & (n_after >= LEFT - high))
            with np.errstate(over="ignore"):
                longer = mix(mix(left[at, low[at]] + low[at].astype(U)) ^ mix(right[at, LEFT - high[at]] + high[at].astype(U)) + prefix[at].view(U))
            rest = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "place", "before", "after")]
            yield pa.RecordBatch.from_arrays([pa.array(longer.view(np.int64)), *rest[:2], pa.array(low[at]), pa.array(high[at]), *rest[2:]], _SUFFIX.replace(",", "").split()[0::2])


def _classes(min_words: int):
    """Suffixes of a hot prefix with the same words about it, as far as their runs reach: the first, in the least document,
    stands for all others, whose b and b_place say so."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["prefix", "salt"]):
            prefix, doc, place, least, most = (table.column(c).to_numpy() for c in ("prefix", "doc_id", "place", "least", "most"))
            (before, n_before), (after, n_after) = _padded(table.column("before")), _padded(table.column("after"))
            left, right = np.minimum(n_before, most), np.minimum(n_after, LEFT - least)
            at = np.arange(len(doc))
            with np.errstate(over="ignore"):
                key = mix(mix(_sums(before)[at, left] + left.astype(U)) ^ mix(_sums(after)[at, right] + right.astype(U)) + prefix.view(U))
            order = np.lexsort((place, doc, key))
            first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            head = np.empty(len(doc), np.int64)
            head[order] = order[np.maximum.accumulate(np.where(first, at, 0))]
            stands = head == at
            b, b_place = pa.array(doc[head], mask=stands), pa.array(place[head], mask=stands)
            yield from table.drop_columns(["salt"]).append_column("b", b).append_column("b_place", b_place).to_batches()

    return classes


def _names(schema: str) -> list[str]:
    return schema.replace(",", "").split()[0::2]


#: A run about the prefix begins `least` to `most` words before it.
_SUFFIX = "prefix long, doc_id long, place int, least int, most int, before binary, after binary"


def equal_stretches(documents: DataFrame, suffixes: DataFrame, min_words: int) -> DataFrame:
    """(a, a_place, b, b_place, length): stretches of equal words of a document a and a lesser document b, which hold every
    run of min_words words about one of the suffixes (prefix, doc_id, place) that a lesser document has, too, about an
    equal prefix. A prefix is min_words - LEFT words.

    Suffixes are dealt by their prefix and sorted by the words after it. Those of a hot prefix would all come to one task:
    they are dealt over salts, and those with the same words about them leave one to stand for all. If these are still
    too many their prefix is made longer by halves, until it is a whole run, of which one is left."""
    spark, keyed = documents.sparkSession, min_words - LEFT
    n, share = partitions(spark), mean_share(suffixes.count(), spark)

    def marked(rows: DataFrame) -> DataFrame:
        return written(rows.join(F.broadcast(hot_keys(rows, "prefix", share)), "prefix", "left"))  # salts: null if not hot

    def about(places: DataFrame) -> DataFrame:
        by_document = places.groupBy("doc_id").agg(F.collect_set(F.struct("place", "prefix")).alias("places"))
        near = Ids(places).rows(rows_of(documents)).join(by_document, "doc_id").mapInArrow(_contexts(min_words), "prefix long, doc_id long, place int, before binary, after binary")
        return near.withColumns({"least": F.lit(0), "most": F.lit(LEFT)}).select("prefix", "doc_id", "place", "least", "most", "before", "after")

    def classed(rows: DataFrame, salt: Column) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(salt, F.col("salts")).cast("long")).select(*_names(_SUFFIX), "salts", "salt")
        return written(salted.repartition(n, "prefix", "salt").sortWithinPartitions("prefix", "salt").mapInArrow(_classes(min_words), f"{_SUFFIX}, salts int, b long, b_place int"))

    def links(told: DataFrame) -> DataFrame:
        left, right = F.least(F.octet_length("before") / 4, F.col("most")).cast("long"), F.least(F.octet_length("after") / 4, LEFT - F.col("least")).cast("long")
        found = told.select(F.col("doc_id").alias("a"), (F.col("place") - left).alias("a_place"), "b", (F.col("b_place") - left).alias("b_place"), (left + right + keyed).alias("length"))
        return found.filter(F.col("length") >= min_words)

    first = marked(suffixes)
    cold, rows, linked = about(first.filter("salts IS NULL")), first.filter("salts IS NOT NULL"), []
    rows = about(rows).join(F.broadcast(rows.select("prefix", "salts").distinct()), "prefix") if not rows.isEmpty() else None
    while rows is not None and not rows.isEmpty():
        # First by document, so that of a class each has one suffix left at most; then what is left of each class, at most
        # one for each of its salts. A document's other suffixes of a class follow the one that stands for them.
        near = F.substring("before", F.lit(1), 4 * F.col("most")), F.substring("after", F.lit(1), 4 * (LEFT - F.col("least")))
        told = classed(rows, F.xxhash64("doc_id"))
        again = classed(told.filter("b IS NULL").drop("b", "b_place"), F.xxhash64(*near))
        stands = again.select("prefix", "doc_id", F.col("place").alias("first_place"), "b", "b_place")
        follow = told.filter("b = doc_id").drop("b").withColumnRenamed("b_place", "first_place")
        follow = written(follow.join(stands, ["prefix", "doc_id", "first_place"]).drop("first_place"))
        linked += [links(told.filter("b <> doc_id")), links(again.filter("b IS NOT NULL")), links(follow.filter("b IS NOT NULL"))]
        rows = again.unionByName(follow).filter("b IS NULL").drop("b", "b_place")
        many = marked(rows.drop("salts"))
        cold = cold.unionByName(many.filter("salts IS NULL").drop("salts"))
        halves = marked(many.filter("salts IS NOT NULL AND least < most").drop("salts").mapInArrow(_halves, _SUFFIX))
        cold = cold.unionByName(halves.filter("salts IS NULL").drop("salts"))
        rows = halves.filter("salts IS NOT NULL")
    found = cold.repartition(n, "prefix").sortWithinPartitions("prefix", "after", "doc_id", "place").mapInArrow(_intervals(min_words), STRETCH)
    for links in linked:
        found = found.unionByName(links)
    return found


def joined_stretches(stretches: DataFrame) -> DataFrame:
    """The passages that stretches on one diagonal of two documents make, each as long as its stretches touch."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["a", "b"]):
            a, b, x, y, length = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "a_place", "b_place", "length"))
            order = np.lexsort((x, x - y, b, a))
            a, b, x, y, length = a[order], b[order], x[order], y[order], length[order]
            line = np.concatenate([[0], np.cumsum((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(x - y) != 0))])
            # The furthest end so far on the same diagonal: diagonals are set apart by more than any place.
            apart = int((x + length).max()) + 1
            reach = np.maximum.accumulate(x + length + line * apart)
            first = np.flatnonzero(np.concatenate([[True], x[1:] + line[1:] * apart > reach[:-1]]))
            last = np.concatenate([first[1:] - 1, [len(a) - 1]])
            n = reach[last] - line[last] * apart - x[first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[first], x[first], n, b[first], y[first], n)], RESULT.replace(",", "").split()[0::2])

    n = partitions(stretches.sparkSession)
    return stretches.repartition(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(join, RESULT)


def with_stretches(found: DataFrame, documents: DataFrame, margin: int) -> DataFrame:
    """For each row of found (a, a_from, a_to, b, b_from, b_to, parts) two rows (a, b, a_from, b_from, side, stretch_low,
    stretch, parts), one after the other: the words of either document as 4-byte hashes, `margin` words wider at each end."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text").to_pylist())
            short = words.hashes.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([short[i:j].tobytes() for i, j in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary())], ["doc_id", "words"])

    key = ["a", "b", "a_from", "b_from"]
    sides = [found.select(*key, F.lit(k).alias("side"), F.col(s).alias("doc_id"), F.col(f"{s}_from").alias("low"), F.col(f"{s}_to").alias("high"), F.col("parts") if not k else F.lit(None).cast("binary").alias("parts")) for k, s in enumerate("ab")]
    needs = sides[0].unionByName(sides[1])
    lists = Ids(needs).mapped(rows_of(documents), hashed, "doc_id long, words binary")
    low = F.greatest(F.col("low") - margin, F.lit(0))
    stretch = F.substring("words", (low * 4 + 1).cast("int"), ((F.col("high") + margin - low) * 4).cast("int"))
    cut = needs.join(lists, "doc_id").select(*key, "side", low.alias("stretch_low"), stretch.alias("stretch"), "parts")
    return cut.repartition(partitions(documents.sparkSession), *key).sortWithinPartitions(*key, "side")


def without_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents with the given passages (doc_id, start_word, n_words) cut from their texts.

    Text before, between and after the cuts stays as it is; the white space after a cut passage goes with it. n_chars, if
    there is such a column, is counted anew. A document that has no words left is dropped; one that had none stays.
    """
    cuts = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_word", "n_words"))).alias("cuts"))
    cuts = written(cuts)
    columns, ids = documents.columns, Ids(cuts)
    own = [c if c in ("doc_id", "text", "n_chars") else f"_{i}" for i, c in enumerate(columns)]
    joined = ids.rows(documents.toDF(*own)).join(cuts, "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, keep = [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                if not marks:
                    texts.append(text)
                    keep.append(True)
                    continue
                raw = (text or "").encode()
                words = Words([raw])
                out, at = [], 0
                for m in marks:
                    end = m["start_word"] + m["n_words"]
                    low = int(words.starts[m["start_word"]]) if m["start_word"] < len(words.starts) else len(raw)
                    if low > at:
                        out.append(raw[at:low])
                    at = max(at, int(words.starts[end]) if end < len(words.starts) else len(raw))
                out.append(raw[at:])
                left = b"".join(out)
                texts.append(left.decode("utf-8", "replace"))
                keep.append(bool(left.split()))
            arrays = [batch.column(c) for c in own]
            arrays[own.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in own:
                old = batch.column("n_chars").to_pylist()
                marked = batch.column("cuts").to_pylist()
                arrays[own.index("n_chars")] = pa.array([len(t) if m else o for t, o, m in zip(texts, old, marked, strict=True)], arrays[own.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    return ids.rows(documents, False).unionByName(joined.select(*own, "cuts").mapInArrow(cut, documents.schema))
