"""Token ids of texts by a byte-level vocabulary, vectorised over a batch.

The text of a batch is split into pre-tokens by array operations on character classes; each distinct pre-token is
encoded by the ``tokenizers`` library once and remembered. A pre-token's ids don't depend on what stands around it, so
the ids are those that the library gives for the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
SHORT = 15
SLOTS = 1 << 20
#: Distinct pre-tokens and bytes of long ones that are remembered before all are forgotten.
REMEMBERED, REMEMBERED_BYTES = SLOTS // 2, 64_000_000


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for lo, hi, shift in ((m.start(), min(m.end(), 0xD800), 0), (max(m.start(), 0xD800), m.end(), 0x800)):
                if lo < hi:
                    out[lo + shift : hi + shift] = kind
    return out


def pre_token_starts(cp: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for code points of several texts in a row; ``first`` marks where texts start.

    A run of letters, of numbers or of other signs is one pre-token together with a space (U+0020) just before it. Of
    white space before something else the last character stands apart; at the end of a text it stays whole. An
    apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll with it.
    """
    kind = kinds[cp]
    space = kind == SPACE
    last = np.r_[first[1:], True]
    before = np.r_[False, space[:-1]] & ~first
    told = np.r_[True, kind[1:] != kind[:-1]]
    after_space = np.r_[True, cp[:-1] != 32]
    start = np.where(space, (~last & ~np.r_[space[1:], True]) | ~before, np.where(before, after_space, told)) | first
    a = np.flatnonzero((cp == 39) & start & ~last)
    if len(a):
        one = cp[a + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.where(last[a + 1], 0, cp[np.minimum(a + 2, len(cp) - 1)])
        pairs = ("re", "ve", "ll")
        long = np.logical_or.reduce([(one == ord(p[0])) & (two == ord(p[1])) for p in pairs])
        a, size = a[short | long], np.where(long, 3, 2)[short | long]
        start[a + 1] = False
        end = a + size
        start[end[end < len(cp)]] = True
    return start


class Encoder:
    """Encodes texts; remembers a bounded number of pre-tokens."""

    def __init__(self, vocabulary: str, kinds: np.ndarray, end_id: int | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
        self.mark = (self.special[0], self.library.token_to_id(self.special[0])) if self.special else None
        self.kinds, self.end_id = kinds, end_id
        size = np.minimum(np.arange(SHORT + 1), 8)
        self.low_mask = np.array([(1 << 8 * int(n)) - 1 for n in size], np.uint64)
        self.high_mask = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(SHORT + 1)], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.value = np.full(SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.words, self.used = np.zeros(1 << 18, np.int32), 0, 0
        if self.end_id is not None:  # word 0 is the end of a document
            self.add(np.array([self.end_id], np.int32), np.ones(1, np.int64))

    def add(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of new words: their ids in a row, and how many each has."""
        while self.words + len(n) > len(self.at):
            self.at, self.count = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.count, np.zeros_like(self.count)]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        new = np.arange(self.words, self.words + len(n))
        self.at[new], self.count[new] = self.used + np.cumsum(n) - n, n
        self.ids[self.used : self.used + len(flat)] = flat
        self.words, self.used = self.words + len(n), self.used + len(flat)
        return new

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each word): one call of the library, which takes the words as they are split.

        A special token between words, which no word holds, tells where each ends: cheaper than the library's word numbers.
        """
        if self.mark is None:
            e = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
            return np.array(e.ids, np.int32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
        mixed = [self.mark[0]] * (2 * len(words))
        mixed[::2] = words
        ids = np.array(self.library.encode_batch_fast([mixed], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(ids == self.mark[1])
        return ids[ids != self.mark[1]], np.diff(np.r_[-1, ends]) - 1

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, slot) of each key; the slot is the key's own or the free one where it belongs."""
        at = (((low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        number = self.value[at]
        open_ = np.flatnonzero((number >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            spot = at[open_]
            number[open_] = self.value[spot]
            open_ = open_[(number[open_] >= 0) & ((self.low[spot] != low[open_]) | (self.high[spot] != high[open_]))]
        return number, at

    def numbers(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each pre-token of the UTF-8 text ``data``."""
        if self.words > REMEMBERED or self.long_bytes > REMEMBERED_BYTES:
            self.forget()
        out = np.empty(len(start), np.int32)
        short = size <= SHORT
        s, n = start[short], size[short]
        eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))
        low = eight[s] & self.low_mask[n]
        high = (eight[s + 8] & self.high_mask[n]) | (n.astype(np.uint64) << np.uint64(56))
        number, _ = self.find(low, high)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            key = np.stack([low[miss], high[miss]], 1).view("V16").ravel()
            _, one, back = np.unique(key, return_index=True, return_inverse=True)
            pick = miss[one]
            new = self.add(*self.encoded([data[a : a + b].decode() for a, b in zip(s[pick].tolist(), n[pick].tolist())]))
            left = np.arange(len(pick))
            while len(left):  # of keys that want one free slot one gets it, the others look on
                _, spot = self.find(low[pick[left]], high[pick[left]])
                _, won = np.unique(spot, return_index=True)
                self.low[spot[won]], self.high[spot[won]] = low[pick[left[won]]], high[pick[left[won]]]
                self.value[spot[won]] = new[left[won]]
                left = np.delete(left, won)
            number[miss] = new[back]
        out[short] = number
        other = np.flatnonzero(~short)
        words = [data[a : a + b] for a, b in zip(start[other].tolist(), size[other].tolist())]
        fresh = [w for w in dict.fromkeys(words) if w not in self.long]
        if fresh:
            self.long.update(zip(fresh, self.add(*self.encoded([w.decode() for w in fresh])).tolist()))
            self.long_bytes += sum(map(len, fresh))
        out[other] = [self.long[w] for w in words]
        return out

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each text, its end among them) of texts without special strings."""
        whole = "".join(texts)
        data = whole.encode()
        cp = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        size = np.array([len(t) for t in texts], np.int64)
        edge = np.r_[0, np.cumsum(size)]
        first = np.zeros(len(cp), bool)
        first[edge[:-1][size > 0]] = True
        at = np.flatnonzero(pre_token_starts(cp, first, self.kinds)) if len(cp) else np.zeros(0, np.int64)
        if len(data) == len(cp):
            byte = np.r_[at, len(cp)]
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            byte = np.r_[0, np.cumsum(width)][np.r_[at, len(cp)]]
        words = self.numbers(data, byte[:-1], np.diff(byte))
        ends = np.searchsorted(at, edge[1:])  # words up to the end of each text
        if self.end_id is not None:
            words = np.insert(words, ends, 0)
            ends = ends + np.arange(1, len(texts) + 1)
        n = self.count[words]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[words] - np.r_[0, stop[:-1]], n) + np.arange(stop[-1] if len(stop) else 0)]
        return flat, np.diff(np.r_[0, np.r_[0, stop][ends]])

    def encode(self, texts: list[str], chars: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids in a row, ids of each text) of groups of texts, in order; a group has ``chars`` characters or one text."""
        part, size = [], 0
        for t in texts:
            if any(s in t for s in self.special):
                if part:
                    yield self.plain(part)
                    part, size = [], 0
                ids = self.library.encode(t, add_special_tokens=False).ids + ([] if self.end_id is None else [self.end_id])
                yield np.array(ids, np.int32), np.array([len(ids)], np.int64)
                continue
            part.append(t)
            size += len(t)
            if size >= chars:
                yield self.plain(part)
                part, size = [], 0
        if part:
            yield self.plain(part)
