"""Elias-Fano sequences and the two-level n-gram trie that is made of them, in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

from .words import U


class EliasFano:
    """A sequence that never falls: low bits packed at a fixed width, high bits in unary. All queries take arrays."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low_bits = min(low_bits, 56)
        place = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + 2
        high = np.zeros(-(-size // 64), U)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(U))
        bits = np.arange(n, dtype=np.int64) * low_bits
        low = np.zeros(-(-n * low_bits // 64) + 2, U)
        if low_bits:
            part = values & U((1 << low_bits) - 1)
            shift = (bits & 63).astype(U)
            np.bitwise_or.at(low, bits >> 6, part << shift)
            over = shift + U(low_bits) > U(64)
            np.bitwise_or.at(low, (bits[over] >> 6) + 1, part[over] >> (U(64) - shift[over]))
        return EliasFano(n, low_bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bits = i * self.low_bits
        at, shift = bits >> 6, (bits & 63).astype(U)
        value = self.low[at] >> shift
        carry = np.where(shift > U(0), self.low[at + 1] << ((U(64) - shift) & U(63)), U(0))
        return (value | carry) & U((1 << self.low_bits) - 1)

    def _select(self, totals: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the k-th one (or zero, with flip) in the high bits."""
        at = np.minimum(np.searchsorted(totals, k, "right") - 1, len(self.high) - 1)
        word = ~self.high[at] if flip else self.high[at].copy()
        left = k - totals[at]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve: is it in the low part?
            count = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
            right = left >= count
            left = np.where(right, left - count, left)
            place += np.where(right, width, 0)
            word = np.where(right, word >> U(width), word)
        return at * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select(self.ones, i, False) - i).astype(U) << U(self.low_bits)) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """For each value the place of the first element that is not less; n if there is none."""
        values = values.astype(U)
        high = (values >> U(self.low_bits)).astype(np.int64)
        total = int(self.zeros[-1])
        # The elements with these high bits stand between two zeros of the unary part.
        end = self._select(self.zeros, np.minimum(high, total - 1), True) - high
        begin = np.where(high > 0, self._select(self.zeros, np.clip(high - 1, 0, total - 1), True) - high + 1, 0)
        beyond = high >= total
        low_at, high_at = np.where(beyond, self.n, np.clip(begin, 0, self.n)), np.where(beyond, self.n, np.clip(end, 0, self.n))
        wanted = values & U((1 << self.low_bits) - 1)
        while (open_ := low_at < high_at).any():
            middle = (low_at + high_at) // 2
            less = self._low(np.minimum(middle, max(0, self.n - 1))) < wanted
            low_at = np.where(open_ & less, middle + 1, low_at)
            high_at = np.where(open_ & ~less, middle, high_at)
        return low_at

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).tofile(f)
            self.low.tofile(f)
            self.high.tofile(f)

    @staticmethod
    def map(path: str) -> EliasFano:
        n, low_bits, low, high = (int(x) for x in np.fromfile(path, np.int64, 4))
        file = np.memmap(path, U, "r", 32)
        return EliasFano(n, low_bits, file[:low], file[low : low + high])


def _quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each value, and what each byte stands for: the mean of the values in one of `levels` equal intervals.

    Intervals are equal in the logarithm, not in their number of values: the few frequent words make up most of a text
    and so must not share one. No value is off by more than a `levels`-th of the whole range."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    seen, inverse = np.unique(values, return_inverse=True)
    if len(seen) <= levels:
        return inverse.astype(np.uint8), seen
    width = (seen[-1] - seen[0]) / levels
    code = np.minimum((values - seen[0]) / width, levels - 1).astype(np.int64)
    total, count = np.bincount(code, values, minlength=levels), np.bincount(code, minlength=levels)
    return code.astype(np.uint8), total / np.maximum(count, 1)


class Trie:
    """Words of a shard, and under each the words it has followed. Level 1: word hashes and, as monotone pointers, where
    each word's children begin. Level 2: child hashes, each raised by its parent's number << 32, so that the whole level
    never falls and a child is found as the successor of a value relative to its context. Values are single bytes."""

    @staticmethod
    def write(folder: str, words: np.ndarray, unseen: np.ndarray, first: np.ndarray, children: np.ndarray, seen: np.ndarray) -> None:
        """words: sorted; unseen: each word's value after a context that is not its child; first: pointers, one more than
        words; children and seen: child hashes (4 bytes, sorted in each parent) and their values."""
        parent = np.repeat(np.arange(len(words), dtype=U), np.diff(first))
        EliasFano.encode(words).save(os.path.join(folder, "words"))
        EliasFano.encode(first.astype(U)).save(os.path.join(folder, "pointers"))
        EliasFano.encode((parent << U(32)) + children.astype(U)).save(os.path.join(folder, "children"))
        for name, values in (("unseen", unseen), ("seen", seen)):
            code, stands_for = _quantised(values)
            code.tofile(os.path.join(folder, f"{name}.codes"))
            stands_for.astype(float).tofile(os.path.join(folder, f"{name}.values"))

    def __init__(self, folder: str):
        at = lambda name: os.path.join(folder, name)
        self.words, self.pointers, self.children = (EliasFano.map(at(n)) for n in ("words", "pointers", "children"))
        self.codes = {n: np.memmap(at(f"{n}.codes"), np.uint8, "r") if os.path.getsize(at(f"{n}.codes")) else np.zeros(1, np.uint8) for n in ("unseen", "seen")}
        self.values = {n: np.fromfile(at(f"{n}.values"), float) for n in ("unseen", "seen")}

    def node(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not self.words.n:
            return np.full(len(words), -1)
        at = self.words.successor(words)
        there = at < self.words.n
        there[there] = self.words.get(at[there]) == words[there]
        return np.where(there, at, -1)

    def value(self, node: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The value of each (node, context word): of the child if there is one, else of the node alone."""
        out = self.values["unseen"][self.codes["unseen"][node]]
        if not self.children.n:
            return out
        wanted = (node.astype(U) << U(32)) + context.astype(U)
        at = self.children.successor(wanted)
        hit = at < self.pointers.get(node + 1).astype(np.int64)
        hit[hit] = self.children.get(at[hit]) == wanted[hit]
        out[hit] = self.values["seen"][self.codes["seen"][at[hit]]]
        return out
