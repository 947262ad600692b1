"""Elias-Fano sequences and a context trie level on top of them, in anonymous memory maps."""

from __future__ import annotations

import mmap

import numpy as np


def mapped(a: np.ndarray) -> np.ndarray:
    """A copy of the array in a memory map of its own."""
    if not a.nbytes:
        return a
    m = mmap.mmap(-1, a.nbytes)
    m.write(a.tobytes())
    return np.frombuffer(m, a.dtype)


class EliasFano:
    """A non-decreasing sequence of uint64: low bits packed, high bits in unary. ``n * (2 + log(universe / n))`` bits."""

    def __init__(self, values: np.ndarray):
        v = values.astype(np.uint64)
        self.n = len(v)
        top = int(v[-1]) + 1 if self.n else 1
        self.low_bits = min(56, max(0, (top // max(1, self.n)).bit_length() - 1))
        shift = np.uint64(self.low_bits)
        high = (v >> shift).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if self.n else 1
        bits = np.zeros(self.n + self.buckets, np.uint8)
        bits[high + np.arange(self.n)] = 1  # a one per value, a zero after each bucket
        self.size = len(bits)
        self.high = mapped(np.packbits(bits))
        low = v & ((np.uint64(1) << shift) - np.uint64(1))
        if self.low_bits and self.n:
            parts = [np.packbits((low[i : i + 65536, None] >> np.arange(self.low_bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little", axis=None) for i in range(0, self.n, 65536)]
            self.low = mapped(np.concatenate([*parts, np.zeros(16, np.uint8)]))
        else:
            self.low = np.zeros(16, np.uint8)

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.int64) * self.low_bits
        words = np.ndarray((len(self.low) - 8,), "<u8", buffer=self.low.data, strides=(1,))
        return (words[at >> 3] >> (at & 7).astype(np.uint64)) & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high, count=self.size)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(self._bits())
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(np.arange(self.n))

    def access(self, i: np.ndarray) -> np.ndarray:
        ones = np.flatnonzero(self._bits())[i]
        return ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values, -1 where absent: the bucket by the high bits, then its low bits in turn."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        want = x & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        ends = np.flatnonzero(self._bits() == 0) - np.arange(self.buckets)  # values up to the end of each bucket
        inside = np.flatnonzero(high < self.buckets)
        lo = np.where(high[inside] > 0, ends[np.maximum(high[inside] - 1, 0)], 0)
        hi = ends[high[inside]]
        while len(inside):
            mid = (lo + hi) >> 1
            live = lo < hi
            inside, lo, hi, mid = inside[live], lo[live], hi[live], mid[live]
            if not len(inside):
                break
            v = self.lows(mid)
            hit = v == want[inside]
            out[inside[hit]] = mid[hit]
            less = v < want[inside]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            inside, lo, hi = inside[~hit], lo[~hit], hi[~hit]
        return out


STEPS = 4000.0  # codes of a decade


def count_code(count: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes, even in the logarithm and so within 0.03 % up to 10^16; 0 stands for none.

    A count over that of all training tokens is the joint probability that the code stands for.
    """
    code = np.zeros(len(count), np.uint16)
    some = count > 0
    code[some] = np.minimum(np.rint(np.log10(count[some]) * STEPS), 65534).astype(np.uint16) + 1
    return code


def count_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) / STEPS), 0.0)


class TrieLevel:
    """Contexts, monotone pointers to their successors, successors relative to their context, and quantised probabilities.

    Contexts and pointers are Elias-Fano sequences; a lookup finds the context, then searches among its own successors.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray):
        """Context and successor of every n-gram, ascending by both."""
        new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
        self.contexts = EliasFano(context[new])
        self.pointers = EliasFano(np.r_[new, len(context)])
        self.successors = mapped(successor.astype(np.uint32))
        self.codes = mapped(codes)

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of the n-grams' probabilities, 0 where absent; ``context`` ascends."""
        out = np.zeros(len(context), np.uint16)
        new = np.r_[True, context[1:] != context[:-1]][: len(context)]
        place = self.contexts.find(context[new])[np.cumsum(new) - 1]
        ask = np.flatnonzero(place >= 0)
        pointers = self.pointers.values().astype(np.int64)
        lo, hi = pointers[place[ask]], pointers[place[ask] + 1]
        want = successor[ask].astype(np.uint32)
        while len(ask):
            mid = (lo + hi) >> 1
            v = self.successors[mid]
            hit = v == want
            out[ask[hit]] = self.codes[mid[hit]]
            less = v < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            live = ~hit & (lo < hi)
            ask, lo, hi, want = ask[live], lo[live], hi[live], want[live]
        return out
