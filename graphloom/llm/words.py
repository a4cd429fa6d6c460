"""Words as arrays of hashes: `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes, for whole batches of texts at once.

A word's hash is a polynomial over a table of mixed byte values, modulo 2**64, then mixed again. Hashes stand for
words everywhere below; with 64 bits, two different words of one comparison collide with a chance below 1e-9.
"""

from __future__ import annotations

import functools
import re

import numpy as np

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(31)
        x *= U(0x7FB5D329728EA185)
        x ^= x >> U(27)
        x *= U(0x81DADEF4BC2DD44D)
        x ^= x >> U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes over which sums run on; powers of this many places are held, so that memory doesn't grow with a text.
PIECE = 1 << 20
_LINE_END = re.compile(rb"[\x20\x09-\x0D]")


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULT, _INVERSE):
        line = np.full(PIECE + 1, base, U)
        line[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(line))
    return out[0], out[1]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse up to n; those beyond a piece are not kept."""
    up, down = _powers()
    while len(up) < n:
        with np.errstate(over="ignore"):
            up, down = (np.concatenate([x, x * x[-1] * base]) for x, base in ((up, _MULT), (down, _INVERSE)))
    return up, down


class Sums:
    """Hashes of stretches of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * up[: len(data)], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(U))


class Words:
    """The words of a list of texts. hashes, starts, ends: one entry a word; first: where each text's words begin.

    Bytes are taken in pieces that end between words, so that only the words' entries grow with a text's length."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join([*texts, b""])
        self.buffer = buffer = np.frombuffer(joined, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        found, low = [], 0
        while low < len(buffer):
            high = len(buffer)
            if high - low > PIECE and (gap := _LINE_END.search(joined, low + PIECE - 1)):
                high = gap.end()
            piece = buffer[low:high]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[piece], [True]]).view(np.int8)))
            starts, ends = edge[0::2], edge[1::2]
            found.append((Sums(_LOWER[piece] if lower else piece).hashes(starts, ends), starts + low, ends + low))
            low = high
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words that stay in one text, and the word at which each begins."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            value = self.hashes[:n].copy()
            for i in range(1, k):
                value = value * _MULT + self.hashes[i : i + n]
        inside = np.ones(n, bool)
        for i in range(1, k):
            cut = self.first[1:-1] - i
            inside[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(inside)
        return mix(value[at] + U(k)), at

    def run_hashes(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of k words that begin at the given words, whatever k is."""
        up, down = _power(len(self.hashes) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(self.hashes * up[: len(self.hashes)])])
            return mix((total[starts + k] - total[starts]) * down[starts])


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    grams, at = words.grams(k)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts):
        if n >= k:
            out.append(np.unique(grams[cut[i] : cut[i + 1]]))
        elif n:
            with np.errstate(over="ignore"):
                value = U(n)
                for h in words.hashes[words.first[i] : words.first[i + 1]]:
                    value = value * _MULT + h
            out.append(mix(np.array([value], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """For each window the position of its least value, the leftmost of equals; a line shorter than that has one window."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([int(np.argmin(values))])
    order = np.argsort(values, kind="stable")  # ranks have no ties: of equals the leftmost is the least
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # The least of a window is the lesser of a suffix least and a prefix least of blocks one window long.
    padded = np.full(-(-n // window) * window, n, np.int64)
    padded[:n] = rank
    rows = padded.reshape(-1, window)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return order[np.minimum(suffix[: n - window + 1], prefix[window - 1 : n])]


def minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window."""
    return np.unique(window_minima(values, window))
