"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol ids. In every round each sequence finds
its lowest-ranked adjacent pair and merges all its non-overlapping occurrences, all sequences at once,
until no pair has a rank; the surviving symbols are counted. Merging every occurrence of the lowest
pair equals merging them one by one, as a pair made by a merge always ranks after that merge.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require

#: Fixed values of the byte-level vocabulary: the pattern that splits text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 600_000
CHUNK_CHARS = 1_500_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level BPE vocabulary as sorted arrays: pair key -> rank, merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of, self.merged = np.arange(len(pairs), dtype=np.int32), merged
        # open addressing over a power of two: a probe is one gather, and nearly all pairs end at the first
        self.slots = np.full(1 << 20, -1, np.int64)
        self.value = np.full(1 << 20, len(pairs), np.int32)
        place, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.slots[place[left]] < 0]
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.slots[place[won]], self.value[place[won]] = key[won], self.rank_of[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & (len(self.slots) - 1)
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.none = np.int32(len(pairs))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> 40) & (len(self.slots) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) << 32 | right
        at = self.slot(want)
        seen = self.slots[at]
        rank = np.where(seen == want, self.value[at], self.none)
        open_ = np.flatnonzero((seen != want) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            seen = self.slots[at[open_]]
            hit = seen == want[open_]
            rank[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return rank


def symbol_counts(words: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols that are left of each word after all merges."""
    counts = np.array([len(w) for w in words], np.int64)
    sym = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    seq = np.repeat(np.arange(len(words), dtype=np.int32), counts)
    same = seq[1:] == seq[:-1]
    rank = np.full(len(sym), table.none, np.int32)
    rank[:-1][same] = table.ranks(sym[:-1][same], sym[1:][same])
    while len(sym):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(sym)])
        live = np.repeat(best < table.none, size)
        if not live.all():  # finished sequences keep the count they have
            counts[seq[first]] = size
            sym, seq, rank, best, size = sym[live], seq[live], rank[live], best[best < table.none], size[best < table.none]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        # of overlapping hits (x x x) every second one merges, from the left
        run = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (seq[hit[1:]] != seq[hit[:-1]])])
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
        sym[hit] = table.merged[rank[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        new = np.cumsum(keep)[hit] - 1
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        # only pairs that hold a merged symbol change
        stale = np.r_[new, new[new > 0] - 1]
        pair = stale[(stale < len(sym) - 1) & (seq[np.minimum(stale + 1, len(sym) - 1)] == seq[stale])]
        rank[stale] = table.none
        rank[pair] = table.ranks(sym[pair], sym[pair + 1])
    return counts


class Counter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.split = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None

    def words(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.split(part)], len(parts) - 1

    def count(self, texts: Iterable[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        new = list(set().union(*(w for w, _ in split)).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set().union(*(w for w, _ in split)))
        if new:
            self.known.update(zip(new, symbol_counts([w.encode() for w in new], self.table).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, w)) + n for w, n in split]


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row's whole text.

    One map pass, no shuffle. A null text counts as empty (0 tokens); a null id stays null; repeated rows
    give repeated results; an empty table gives none; texts of any length are counted whole. Extra columns are ignored whatever their names.
    ``vocabulary`` is the path of a byte-level BPE vocabulary, read once on the driver.
    """
    require(docs, id_col, text_col)
    merges = MergeTable(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for part in chunks(texts) for c in counter.count(part)]
            yield pa.record_batch({"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
