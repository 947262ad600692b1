"""Substring deduplication by collinear chaining.

Seeds are the minimizers among all word k-mers (the least of every few in a row), packed by parts of their hashes for
the shuffle. A document that holds a seed is joined with the first and with the previous document that do, so a passage
in n documents costs 2 n matches, not n squared. Per pair of documents the matches are chained in order, with linear
gap costs, through a Fenwick tree; each chain's stretch of both texts is then aligned (longest common subsequence,
bit-parallel) and extended at its ends over changed words, which finds passages that differ here and there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, stored
from ledgerlens.llm.ngram_join import groups, mix

WEIGHT, GAP = 6.0, 0.06  # of a seed in a chain, of a word between two seeds
REACH = 40  # words from one seed of a chain to the next: as far as one change can part them
STEP = 16  # words between the points that stand for a run of matches
CHUNK = 700_000  # words whose seeds are packed at once
PART = 30_000_000  # characters of text whose seeds make one part, in the mean
TASK = 8_000_000  # characters of text for one task
#: Words to leave out of both texts where they part, and equal words that must follow.
SKIPS = ((1, 1, 1), (0, 1, 2), (1, 0, 2), (2, 2, 1), (1, 2, 2), (2, 1, 2), (0, 2, 2), (2, 0, 2), (3, 3, 1))


class Words:
    """Hashed words of texts: lower case, split at white space."""

    def __init__(self):
        self.known = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > 400_000:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(h: np.ndarray, doc: np.ndarray, k: int, near: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimizers of texts laid end to end; ``doc`` numbers the text of every word.

    Of every ``window`` k-mers in a row the one of least hash is a seed, and every k-mer of texts with fewer. A k-mer
    that comes again within ``near`` words (periodic text) is told apart by its number in the row, so that periodic
    passages give ordered seeds too.
    """
    size = max(0, len(h) - k + 1)
    x = h[:size].copy()
    for i in range(1, k):
        x = mix(x) + h[i : i + size]
    at = np.flatnonzero(doc[:size] == doc[k - 1 : k - 1 + size])
    x = mix(x)[at]
    key = mix(x + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, (key[order][1:] != key[order][:-1]) | (np.diff(at[order]) > near)][: len(at)]
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    again = order[nth > 0]
    d, few = doc[at], max(0, len(at) - window + 1)
    least = np.arange(few)
    for i in range(1, window):
        j = np.arange(i, i + few)
        least = np.where(x[j] < x[least], j, least)
    chosen = np.zeros(len(at), bool)
    chosen[least[d[:few] == d[window - 1 : window - 1 + few]]] = True
    chosen |= (np.bincount(d, minlength=1) < window)[d]
    x[again] = mix(x[again] + nth[nth > 0].astype(np.uint64))
    return at[chosen], x[chosen]


def seed_rows(k: int, near: int, window: int, parts: int):
    """Seeds packed by part of the hash: documents with their numbers of seeds, 48 bits of every hash, places."""

    def packed(ids: list, texts: list) -> pa.RecordBatch:
        n = np.array([len(h) for h in texts])
        doc, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        at, x = seeds(np.concatenate(texts), doc, k, near, window)
        part = ((x >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, d, x = part[order], doc[at][order], x[order]
        pos = (at[order] - start[d]).astype(np.uint32)
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (d[1:] != d[:-1])][: len(d)])
        held, count = np.array(ids, np.int64)[d[new]], np.diff(np.r_[new, len(d)]).astype(np.uint32)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(d)])
        runs = np.r_[np.searchsorted(new, cut), len(new)]
        cut = np.r_[cut, len(d)]
        h0, h1, p0, p1 = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16), pos.astype(np.uint16), (pos >> np.uint32(16)).astype(np.uint16)
        spans, docs = list(zip(cut[:-1], cut[1:])), list(zip(runs[:-1], runs[1:]))
        cols = [[held[i:j].tobytes() for i, j in docs], [count[i:j].tobytes() for i, j in docs], [h0[i:j].tobytes() + h1[i:j].tobytes() for i, j in spans], [p0[i:j].tobytes() + p1[i:j].tobytes() for i, j in spans]]
        return pa.record_batch([pa.array(part[cut[:-1]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "ids", "n", "h", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, texts, size = Words(), [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = words(text.as_py())
                if len(h) >= k:
                    ids.append(i)
                    texts.append(h)
                    size += len(h)
                if size >= CHUNK:
                    yield packed(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts)

    return run


def halves(blobs: list[bytes], low: type) -> np.ndarray:
    """Numbers packed as their low parts followed by 16 bits on top of each."""
    width = np.dtype(low).itemsize
    out = []
    for b in blobs:
        n = len(b) // (width + 2)
        out.append(np.frombuffer(b, low, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, width * n).astype(np.uint64) << np.uint64(8 * width))
    return np.concatenate(out)


def match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed seeds, sorted by part, to matches of each with the first and the previous document, by id, that hold it."""
    for t in groups(batches, 1):
        h = halves(t["h"].to_pylist(), np.uint32)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(h) > 1 else order[:0]
        if not len(order):
            continue
        ids = np.repeat(np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64), np.frombuffer(b"".join(t["n"].to_pylist()), np.uint32))[order]
        pos, h = halves(t["pos"].to_pylist(), np.uint16)[order].astype(np.int32), h[order]
        order = np.lexsort((pos, ids, h))
        ids, pos, h = ids[order], pos[order], h[order]
        new = np.r_[True, h[1:] != h[:-1]]
        holder = new | np.r_[True, ids[1:] != ids[:-1]]  # the first place of a document in a seed
        place, nth = np.flatnonzero(holder), np.cumsum(holder) - 1
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        before = place[np.maximum(nth - 1, 0)]
        late = ids != ids[first]
        for other, rows in ((first, np.flatnonzero(late)), (before, np.flatnonzero(late & (ids[before] != ids[first])))):
            for i in range(0, len(rows), 500_000):
                r = rows[i : i + 500_000]
                yield pa.record_batch({"id": pa.array(ids[r]), "other": pa.array(ids[other[r]]), "x": pa.array(pos[r]), "y": pa.array(pos[other[r]])})


def chains(x: np.ndarray, y: np.ndarray, least: int = 2) -> list[np.ndarray]:
    """Matches (x ascending) as disjoint collinear chains, best first: indices with x and y strictly rising.

    A Fenwick tree over the ranks of y holds the best prefix of score + GAP * (x + y); a chain is worth its seeds less
    GAP for every word between them, and starts anew where its past is worth nothing.
    """
    n = len(x)
    ranks = np.unique(y, return_inverse=True)[1] + 1
    top = int(ranks.max(initial=0))
    tree, back, score = [(-1e18, -1)] * (top + 1), [-1] * n, [0.0] * n
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches at one place don't follow each other
            r, best = rs[j] - 1, (-1e18, -1)
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            past = best[0] - GAP * (xs[j] + ys[j])
            score[j] = WEIGHT + max(0.0, past)
            back[j] = best[1] if past > 0 else -1
            j += 1
        for m in range(i, j):
            r, mine = rs[m], (score[m] + GAP * (xs[m] + ys[m]), m)
            while r <= top:
                if mine > tree[r]:
                    tree[r] = mine
                r += r & -r
        i = j
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: -score[m]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        c = np.array(chain[::-1], np.int64)
        far = np.flatnonzero((np.diff(x[c]) > REACH) | (np.diff(y[c]) > REACH)) + 1
        out += [part for part in np.split(c, far) if len(part) >= least]
    return out


def segments(other: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, window: int) -> tuple[np.ndarray, ...]:
    """Matches that follow each other within ``window`` words at one distance as few points: every ``STEP``-th and the last, with the matches that each stands for. Documents with under ``least`` matches are left out."""
    order = np.lexsort((x, y - x, other))
    other, x, y = other[order], x[order], y[order]
    new = np.r_[True, (other[1:] != other[:-1]) | (np.diff(y - x) != 0) | (np.diff(x) > window)]
    last = np.r_[new[1:], True]
    at = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    point = np.flatnonzero((at % STEP == 0) | last)
    n = np.diff(np.r_[-1, point])
    u, which = np.unique(other[point], return_inverse=True)
    point, n = (v[np.bincount(which, n)[which] >= least] for v in (point, n))
    order = np.lexsort((y[point], x[point], other[point]))
    point, n = point[order], n[order]
    return other[point], x[point], y[point], n


def chain_rows(k: int, least: int, window: int):
    """Matches sorted by document to chains of ``least`` seeds or more: pair of documents and both stretches in words.

    Of chains over one stretch with several partners, those with fewer seeds in it than another's add nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            other, x, y, n = segments(*(t[c].to_numpy() for c in ("other", "x", "y")), least, window)
            cut = np.flatnonzero(np.r_[True, other[1:] != other[:-1], True]) if len(other) else [0]
            found = []
            for a, b in zip(cut[:-1], cut[1:]):
                for c in chains(x[a:b], y[a:b], 1):
                    c = c + a
                    size = int(n[c].sum())
                    if size >= least:
                        found.append((size, int(other[a]), int(x[c[0]]), int(x[c[-1]]) + k, int(y[c[0]]), int(y[c[-1]]) + k, x[c], np.r_[0, np.cumsum(n[c])]))
            rows, whole = [], []
            for size, o, x0, x1, y0, y1, at, held in sorted(found, key=lambda f: (-f[0], f[1:6])):
                if not any(lo <= x0 and x1 <= hi and h[np.searchsorted(a, x1 - k, side="right")] - h[np.searchsorted(a, x0)] >= size for lo, hi, a, h in whole):
                    rows.append((o, x0, x1, y0, y1))
                    whole.append((x0, x1, at, held))
            if rows:
                o, x0, x1, y0, y1 = zip(*rows)
                yield pa.record_batch({"id": pa.array([t["id"][0].as_py()] * len(rows), pa.int64()), "other": pa.array(o, pa.int64()), "x0": pa.array(x0, pa.int32()), "x1": pa.array(x1, pa.int32()), "y0": pa.array(y0, pa.int32()), "y1": pa.array(y1, pa.int32())})

    return run


def slice_rows(margin: int):
    """Hashed words of a stretch of a text with ``margin`` words around it, and how many of those stand before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, h = Words(), None, None
        for b in batches:
            before, cut = [], []
            lo, hi = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, text in enumerate(b.column(3)):
                text = text.as_py()
                if text is not last:
                    if text != last:
                        h = (words(text) >> np.uint64(32)).astype(np.uint32)
                    last = text
                at = max(0, int(lo[i]) - margin)
                before.append(int(lo[i]) - at)
                cut.append(h[at : int(hi[i]) + margin].tobytes())
            yield pa.record_batch({"id": b.column(0), "lo": b.column(1), "hi": b.column(2), "before": pa.array(before, pa.int32()), "words": pa.array(cut, pa.binary())})

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    front = n if same.all() else int(same.argmin())
    x, y = x[front:], y[front:]
    n = min(len(x), len(y))
    same = x[::-1][:n] == y[::-1][:n]
    end = n if same.all() else int(same.argmin())
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x) or not len(y):
        return front + end
    place: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y.tolist():
        m = place.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return front + end + len(x) - v.bit_count()


def grown(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """How far two texts stay alike from their starts: words of each and how many are equal.

    An equal word gains one, a changed, added or left-out one costs one; the farthest end that is at most two under
    the best counts, and 6 under the best it stops.
    """
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    i = n if same.all() else int(same.argmin())
    if i == n:
        return i, i, i
    x, y = x.tolist(), y.tolist()
    j = equal = score = i
    best, out = i, (i, j, i)
    while score > best - 6:
        for a, b, need in SKIPS:
            p, q = i + a, j + b
            if p + need <= len(x) and q + need <= len(y) and x[p : p + need] == y[q : q + need]:
                break
        else:
            break
        i, j, score = p, q, score - max(a, b)
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j, score, equal = i + 1, j + 1, score + 1, equal + 1
        if score >= best - 2:
            best, out = max(best, score), (i, j, equal)
    return out


def align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        get = {n: b.column(n).to_numpy() for n in ("x0", "x1", "y0", "y1", "xb", "yb")}
        add, same = np.zeros((b.num_rows, 4), np.int32), []
        for i in range(b.num_rows):
            x, y = (np.frombuffer(b.column(n)[i].as_py(), np.uint32) for n in ("xw", "yw"))
            xb, yb, nx, ny = (int(v) for v in (get["xb"][i], get["yb"][i], get["x1"][i] - get["x0"][i], get["y1"][i] - get["y0"][i]))
            fx, fy, front = grown(x[:xb][::-1], y[:yb][::-1])
            ex, ey, end = grown(x[xb + nx :], y[yb + ny :])
            add[i] = fx, ex, fy, ey
            same.append(2 * (common(x[xb : xb + nx], y[yb : yb + ny]) + front + end) / (nx + ny + fx + fy + ex + ey))
        yield pa.record_batch({
            "id": b.column("id"), "other": b.column("other"), "x0": pa.array(get["x0"] - add[:, 0]), "x1": pa.array(get["x1"] + add[:, 1]), "y0": pa.array(get["y0"] - add[:, 2]), "y1": pa.array(get["y1"] + add[:, 3]), "identity": pa.array(same, pa.float64()),
        })


def merged_rows(least: int):
    """Passages of one document that lie in stretches of ``least`` words or more, where overlapping and touching passages make one stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            x0, x1 = t["x0"].to_numpy(), t["x1"].to_numpy()
            order = np.lexsort((x1, x0))
            far = np.maximum.accumulate(x1[order])
            new = np.r_[True, x0[order][1:] > far[:-1]]
            part = np.cumsum(new) - 1
            lo, hi = x0[order][new], np.r_[far[:-1][new[1:]], far[-1:]]
            good = order[(hi - lo >= least)[part]]
            if len(good):
                yield from t.take(pa.array(np.sort(good))).combine_chunks().to_batches()

    return run


def repeated_passages(docs: DataFrame, *, min_words: int = 50, identity: float = 0.8, k: int = 4, window: int = 4, near: int = 16, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, other_id, start, stop, other_start, other_stop, n_words, identity``: stretches of a document, in words, that an earlier one holds too.

    Earlier documents are the one of least id and the next lower id for each seed, so every document but the first of
    those that share a passage has a row for it. Stretches reach ``min_words`` (touching ones of several partners count
    as one) and ``identity``, and share ``least`` seeds; ``window`` 1 makes every k-mer a seed. Null and empty texts and
    rows with a null id hold nothing; texts of any length are read whole, in slices; aligned pieces of under a fifth of ``min_words`` don't
    join a stretch; rows that repeat an id hold what either does, each text against the others' ids
    only; extra columns are ignored; an empty table gives no rows.
    """
    require(docs, id_col, text_col)
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(16, chars // TASK)  # the work of a task isn't in its bytes, so its number isn't left to them
    packed = base.mapInArrow(seed_rows(k, near, window, max(256, chars // PART)), "part int, ids binary, n binary, h binary, pos binary")
    match = packed.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(match_rows, "id long, other long, x int, y int")
    chained = match.repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(chain_rows(k, least, window), "id long, other long, x0 int, x1 int, y0 int, y1 int")
    chained = stored(chained, "passage-chains")
    ends = chained.select("id", F.col("x0").alias("lo"), F.col("x1").alias("hi")).unionByName(chained.select(F.col("other").alias("id"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))).distinct()
    cut = ends.join(base, "id").select("id", "lo", "hi", "text").mapInArrow(slice_rows(min_words), "id long, lo int, hi int, before int, words binary")
    cut = stored(cut.distinct(), "passage-slices")
    x = cut.select("id", F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("before").alias("xb"), F.col("words").alias("xw"))
    y = cut.select(F.col("id").alias("other"), F.col("lo").alias("y0"), F.col("hi").alias("y1"), F.col("before").alias("yb"), F.col("words").alias("yw"))
    both = chained.join(x, ["id", "x0", "x1"]).join(y, ["other", "y0", "y1"]).select("id", "other", "x0", "x1", "y0", "y1", "xb", "yb", "xw", "yw")
    schema = "id long, other long, x0 int, x1 int, y0 int, y1 int, identity double"
    aligned = both.mapInArrow(align_rows, schema).where((F.col("identity") >= identity) & (F.col("x1") - F.col("x0") >= min_words // 5))
    kept = aligned.distinct().repartition("id").sortWithinPartitions("id", "x0").mapInArrow(merged_rows(min_words), schema)
    return kept.select(F.col("id").alias(id_col), F.col("other").alias("other_id"), F.col("x0").alias("start"), F.col("x1").alias("stop"), F.col("y0").alias("other_start"), F.col("y1").alias("other_stop"), (F.col("x1") - F.col("x0")).alias("n_words"), "identity")
