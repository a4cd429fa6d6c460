"""Token counts and ids of public tokenizers: pre-tokens by character classes, each looked up once, and overlap
resynchronisation for huge texts.

Byte-level BPE never merges across pre-tokens, so the tokens of a text are those of its pre-tokens in turn. In texts that
have only Latin-1 characters, whose classes no Unicode version has changed, array operations over whole batches find the
pre-tokens; each distinct one goes to the library once, and a cache of fixed size holds what it gave. Any other text, and
one with a special token's string, goes to the library whole.

A text over `CHUNK_CHARS` characters is encoded in overlapping chunks. The pre-token scan only looks forward, from
where its last match ended, and one character past a match: so where two scans both begin a pre-token they agree from
there on. A place in the overlap at which both chunks begin a pre-token, with a margin at either end that no special
token's string or cut match reaches over, is such a boundary: tokens of the first chunk before it and of the second
from it are those of the whole. If an overlap has none, it is doubled; if the whole chunk has none, the chunk is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, narrow, text_bytes
from .words import U, Sums

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Characters that a chunk's end may have spoilt: more than any special token has, and a match's look-ahead.
MARGIN = 32
#: Pre-tokens that the cache holds, in about 30 bytes each.
CACHE_ENTRIES = 500_000
LIMIT = 512

# The classes of Latin-1 characters in the vocabularies' pre-token patterns, and their contractions.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµºÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_NUMBERS = "0123456789²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r "
_SHORT, _LONG = "sdmt", ("ll", "ve", "re")

_SPACE, _LETTER, _NUMBER, _OTHER, _END, _FOREIGN = range(6)


def _class(character: str) -> int:
    if character in _SPACES:
        return _SPACE
    return _LETTER if character in _LETTERS else _NUMBER if character in _NUMBERS else _OTHER


# Of a byte; and of a character's second byte after each of the two leading bytes that Latin-1 has.
_ASCII = np.full(256, _FOREIGN, np.uint8)
_ASCII[[*range(9, 14), *range(32, 127)]] = [_class(chr(i)) for i in (*range(9, 14), *range(32, 127))]
_ASCII[0] = _END
_AFTER = {lead: np.full(256, _FOREIGN, np.uint8) for lead in (0xC2, 0xC3)}
for _code in range(0xA1, 0x100):
    _AFTER[0xC2 + (_code >> 6) - 2][0x80 | _code & 0x3F] = _class(chr(_code))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _ASCII[data]
    far = np.flatnonzero(data >= 0x80)
    if len(far):
        for lead, table in _AFTER.items():
            first = far[data[far] == lead]
            first = first[first + 1 < len(data)]
            out[first + 1] = out[first] = table[data[first + 1]]
    return out


def _is(data: np.ndarray, at: np.ndarray, letters: str) -> np.ndarray:
    return np.isin(data[np.minimum(at, len(data) - 1)], np.frombuffer(letters.encode(), np.uint8))


def pretokens(data: np.ndarray, kinds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of texts that each end with a zero byte. With `words`, white space belongs to none and
    each digit is one; without, a space belongs to what follows it, and the rest of white space is a pre-token."""
    size = len(data)
    begin = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    begin[kinds == _END] = True
    if words:
        begin[(kinds == _NUMBER) & ((data < 0x80) | (data >= 0xC0))] = True
    quotes = np.flatnonzero(begin & (data == ord("'")))
    if not words:
        quotes = quotes[data[quotes - 1] != 32] if len(quotes) and quotes[0] else np.concatenate([quotes[:1], quotes[1:][data[quotes[1:] - 1] != 32]])
        # White space before other characters: its last character stands alone, or joins them if it is a space.
        first = np.flatnonzero(begin)
        after = np.concatenate([first[1:], [size]])[kinds[first] == _SPACE]
        inside = after < size
        inside[inside] = kinds[after[inside]] != _END
        last = after[inside] - 1
        begin[last] = True
        begin[last[data[last] == 32] + 1] = False
    if len(quotes):
        short = _is(data, quotes + 1, _SHORT)
        long = np.zeros(len(quotes), bool)
        for pair in _LONG:
            long |= _is(data, quotes + 1, pair[0]) & _is(data, quotes + 2, pair[1])
        for which, length in ((short, 2), (long & ~short, 3)):
            at = quotes[which]
            begin[at + 1] = False
            begin[at + length] = True
    starts = np.flatnonzero(begin)
    ends = np.concatenate([starts[1:], [size]])
    keep = kinds[starts] != _END
    if words:
        keep &= kinds[starts] != _SPACE
    return starts[keep], ends[keep]


class Encoder:
    """One tokenizer of a .json file in a task."""

    def __init__(self, name: str, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or tokenizer_path(name))
        self.words = "word" in name
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        #: Sorted keys of known pre-tokens, and for each where its ids begin in `flat`, and how many they are.
        self.keys, self.first, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _known(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """The number of each pre-token's entry in the cache; new ones go to the library."""
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_ENTRIES:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        missing = np.flatnonzero(np.concatenate([self.keys, [U(0)]])[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(missing):
            new = [data[starts[i] : ends[i]].decode() for i in sample[missing]]
            got = [e.ids for k in range(0, len(new), 4096) for e in self.library.encode_batch_fast(new[k : k + 4096], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            first = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.array([i for ids in got for i in ids], np.uint32)])
            self.keys, self.first, self.size = (np.insert(old, at[missing], add) for old, add in ((self.keys, distinct[missing]), (self.first, first), (self.size, size)))
            at = np.searchsorted(self.keys, distinct)
        return at[inverse]

    def _entries(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(starts in the joined texts, entries, where each text's pre-tokens begin, texts for the library)."""
        joined = b"\0".join([*texts, b""])
        raw = np.frombuffer(joined, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        kinds = _classes(raw)
        inner = np.ones(len(raw), bool)
        inner[offsets[1:] - 1] = False
        foreign = np.flatnonzero((kinds == _FOREIGN) | ((kinds == _END) & inner))
        whole = {int(i) for i in np.unique(np.searchsorted(offsets, foreign, "right") - 1)}
        whole |= {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        data = raw
        if self.words:
            data = _LOWER[raw]
            far = np.flatnonzero(data == 0xC3)
            far = far[far + 1 < len(data)] + 1
            data[far[(data[far] >= 0x80) & (data[far] <= 0x9E) & (data[far] != 0x97)]] += 32
        starts, ends = pretokens(data, kinds, self.words)
        if whole:
            drop = np.zeros(len(texts), bool)
            drop[list(whole)] = True
            keep = ~drop[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        entries = self._known(Sums(data).hashes(starts, ends), starts, ends, data.tobytes()) if len(starts) else np.zeros(0, np.int64)
        return starts, entries, np.searchsorted(starts, offsets), sorted(whole)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        _, entries, cut, whole = self._entries(texts)
        total = np.concatenate([[0], np.cumsum(self.size[entries])])
        out = total[cut[1:]] - total[cut[:-1]]
        for i in whole:
            out[i] = len(self._whole(texts[i]))
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        _, entries, cut, whole = self._entries(texts)
        size = self.size[entries]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.first[entries] - total[:-1], size) + np.arange(total[-1])]
        out = [flat[i:j] for i, j in zip(total[cut[:-1]], total[cut[1:]], strict=True)]
        for i in whole:
            out[i] = self._whole(texts[i])
        return out

    def marks(self, text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token of text begins, in characters counted from `start` on, and how many tokens it has."""
        raw = text.encode("utf-8", "replace")
        starts, entries, _, whole = self._entries([raw])
        if not whole:
            data = np.frombuffer(raw, np.uint8)
            character = np.cumsum((data < 0x80) | (data >= 0xC0)) - 1
            return character[starts] + start, self.size[entries]
        got = self.library.encode(text, add_special_tokens=False)
        if not len(got.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A special token has no pre-token number: it stands as one of its own, which begins where it is written.
        number = [-2 - i if w is None else w for i, w in enumerate(got.word_ids)]
        begin = np.array([o[0] for o in got.offsets], np.int64)
        special = set(self.library.get_added_tokens_decoder())
        alone = np.array([i in special for i in got.ids])
        first = np.concatenate([[True], np.array(number[1:]) != np.array(number[:-1])]) | alone | np.concatenate([[False], alone[:-1]])
        at = np.flatnonzero(first)
        return begin[at] + start, np.diff(np.concatenate([at, [len(got.ids)]]))


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def count_spliced(enc: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of a long text, from overlapping chunks that are spliced at stable boundaries."""
    total, begin, skip = 0, 0, 0  # tokens of text[:skip] are counted; the chunk begins at `begin`
    end = min(len(text), begin + chunk)
    at, counts = enc.marks(text[begin:end], begin)
    while end < len(text):
        width = overlap
        while True:
            start = max(begin, end - width)
            stop = min(len(text), end + chunk)
            if start <= skip or start == begin:  # no boundary in the whole chunk: one twice as long, so that work stays in proportion
                end = min(len(text), begin + 2 * (end - begin))
                at, counts = enc.marks(text[begin:end], begin)
                break
            at2, counts2 = enc.marks(text[start:stop], start)
            shared = np.intersect1d(at, at2)
            shared = shared[(shared >= start + MARGIN) & (shared <= end - MARGIN) & (shared < at[-1])]
            if len(shared):
                cut = int(shared[-1])
                total += int(counts[(at >= skip) & (at < cut)].sum())
                begin, end, skip, at, counts = start, stop, cut, at2, counts2
                break
            width *= 2
    return total + int(counts[at >= skip].sum())


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty, with no tokens.

    Repeated rows get a row each, extra columns are ignored, an empty table gives no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in chunks(batches, "text"):
            raw = batch.column("text").to_pylist()
            long = {i: t.decode("utf-8", "replace") for i, t in enumerate(raw) if len(t) > CHUNK_CHARS}
            texts = {i: t for i, t in long.items() if len(t) > CHUNK_CHARS}
            n = enc.counts([b"" if i in texts else t for i, t in enumerate(raw)])
            for i, text in texts.items():
                n[i] = count_spliced(enc, text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = narrow(documents, doc_id="doc_id", text="text").select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
