"""Suffix-array dedup: a sparse suffix array over the words of all texts.

Only suffixes that begin at content-selected places (minimisers) are kept: a passage holds the same ones in every
document. Every run of min_words words begins at most LEFT words before the first of its own, so two documents that share
the run share min_words - LEFT words there, the suffixes' prefix. Suffixes are dealt by prefix, those with another
document beside them are sorted by the words that follow, and neighbours are compared: what they have in common parts the
array into intervals of ever longer prefixes. In each interval the match is extended to the left by what is left of the
run's words. So a pair is found even where other texts sort between the two, and no text is held against all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, dealt, hot_keys, runs, written
from .passages import ANCHORED, GRAM, LEAST_MIN_WORDS, LEFT, MIN_WORDS, copied, copies_of, distinct_texts, equal_stretches, joined_stretches, rows_of, without_passages
from .words import Words, minimisers

#: The share of documents from which hot prefixes are told. It decides only how rows are dealt, never what is found.
SAMPLE = 0.01


def _suffixes(min_words: int):
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text").to_pylist())
            grams, at = words.grams(GRAM)
            cut = np.searchsorted(at, words.first)
            selected, counts = [], words.counts
            for i in range(batch.num_rows):
                place = minimisers(grams[cut[i] : cut[i + 1]], ANCHORED)
                selected.append(place[place + min_words - LEFT <= counts[i]])
            sizes = [len(s) for s in selected]
            place = np.concatenate(selected)
            prefix = words.run_hashes(place + np.repeat(words.first[:-1], sizes), min_words - LEFT)
            docs = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(docs), pa.array(place.astype(np.int32))], ["prefix", "doc_id", "place"])

    return suffixes


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose prefix another document has, too, and all of a hot prefix, whose documents are dealt apart."""
    for table in runs(batches, ["prefix", "salt"]):
        prefix, salt, doc = (table.column(c).to_numpy() for c in ("prefix", "salt", "doc_id"))
        begin = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (salt[1:] != salt[:-1])]))
        end = np.concatenate([begin[1:], [len(doc)]])
        keep = np.repeat((salt[begin] > 0) | (doc[begin] < doc[end - 1]), end - begin)
        yield from table.select(["prefix", "doc_id", "place"]).filter(pa.array(keep)).to_batches()


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, source_doc_id, source_start_word, n_equal): runs of at least min_words equal words that
    doc_id shares with a lesser source_doc_id.

    Every run of min_words words that a lesser document has, too, is in a passage. Passages of one document overlap where parts of it have different sources, or
    where a text repeats itself. A copy of a whole text is one passage of all its words. Words are compared with A-Z
    lowered. Texts under min_words words, null and empty ones have no passages, and rows without a doc_id are left out.
    Repeated rows are one document; rows of one doc_id with different texts are searched as texts of one document. Extra
    columns are ignored; an empty table gives no rows. min_words may not be under LEAST_MIN_WORDS, below which a passage
    may hold no suffix.
    """
    if min_words < LEAST_MIN_WORDS:
        raise ValueError(f"min_words must be at least {LEAST_MIN_WORDS}")
    copies = copies_of(documents)
    schema = "prefix long, doc_id long, place int"
    hot = hot_keys(rows_of(documents.sample(SAMPLE, seed=1)).mapInArrow(_suffixes(min_words), schema), "prefix")
    suffixes = dealt(distinct_texts(documents, copies, _suffixes(min_words), schema), "prefix", hot, "doc_id")
    shared = written(suffixes.mapInArrow(_shared, schema))
    found = written(joined_stretches(equal_stretches(documents, shared, min_words)).distinct())
    return found.unionByName(copied(copies, min_words))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with every passage cut that a document of a lesser doc_id holds too."""
    return without_passages(documents, repeated_passages(documents).select("doc_id", "start_word", "n_words"))
