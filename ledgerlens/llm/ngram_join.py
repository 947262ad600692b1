"""N-gram Jaccard join by chosen paths.

A document is the set of its word 5-grams. Equal sets collapse to one. Each set is embedded in 64 min-hash
tokens, and every run lets a set follow the paths on which hashed choices of its own tokens lead it; similar
sets choose alike and meet in a bucket. Buckets still too large are split by further tokens, those that never
split (near copies) are reduced to leaders chunk by chunk, small ones are compared by bit sketches. Runs
repeat until the wanted recall; all pairs found are checked on the sets themselves, groups are connected, and
links are counted exactly within each group, where blocks close to the group's centre need no comparison
(the Jaccard distance is a metric).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, small_side, stored

BINS, TOKENS = 256, 64
DEPTH = 3
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Hashed word n-grams of texts: lower case, split at white space; a text of fewer words is one n-gram."""

    def __init__(self, n: int):
        self.n, self.words = n, {}
        self.weight = [mix(np.uint64([i + 1]))[0] | np.uint64(1) for i in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted unique hashes; none for a text without words."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) > 400_000:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        m = min(self.n, len(h))
        size = len(h) - m + 1
        out = h[:size] * self.weight[0]
        for i in range(1, m):
            out = out + h[i : i + size] * self.weight[i]
        return np.unique(mix(out))


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``: the paths both choose form a critical branching process."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def choice(threshold: float) -> np.uint64:
    """Hashes under this choose a token: so many that two sets at the threshold choose one in common on each path, in the mean."""
    return np.uint64(min(2**64 - 1, int(2**64 / (threshold * TOKENS))))


def extend(path: np.ndarray, tokens: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Each path followed by every token that its hash chooses: (index of the path, longer path)."""
    h = mix(path[:, None] + tokens[None, :])
    at, tok = np.nonzero(h < limit)
    return at, mix(h[at, tok] + tokens[tok])


def signature(u: np.ndarray) -> np.ndarray:
    """256 min-hashes of one permutation: the least hash at or after each of 256 even places, round the circle."""
    return u[np.searchsorted(u, STARTS) % len(u)]


def paths(tokens: np.ndarray, runs: int, limit: np.uint64, depth: int = DEPTH) -> np.ndarray:
    p = mix(np.arange(1, runs + 1, dtype=np.uint64))
    for _ in range(depth):
        if not len(p):
            break
        p = extend(p, tokens, limit)[1]
    return np.unique(p)


def tokens_of(sig: np.ndarray) -> np.ndarray:
    return mix(sig[:: BINS // TOKENS] + np.arange(TOKENS, dtype=np.uint64))


def sketch_rows(n: int, runs: int, limit: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for b in batches:
            key, size, bits, toks, path = [], [], [], [], []
            for text in b.column(1):
                u = shingle(text.as_py())
                if not len(u):
                    for c in (key, size, bits, toks, path):
                        c.append(None)
                    continue
                sig = signature(u)
                t = tokens_of(sig)
                key.append(xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63))
                size.append(len(u))
                bits.append(np.packbits((sig * M1 >> np.uint64(63)).astype(np.uint8)).tobytes())
                toks.append(t.tobytes())
                path.append(paths(t, runs, limit).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(toks, pa.binary()), pa.array(path, pa.list_(pa.int64()))],
                names=["id", "k", "n", "bits", "toks", "paths"],
            )

    return run


def groups(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.Table]:
    """Runs of equal first column, of ``least`` rows or more, in sorted input; single rows are skipped without a loop."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        rest = None
        if not t.num_rows:
            continue
        k = t.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        rest = t.slice(int(cut[-2]))
        size = np.diff(cut[:-1])
        for i in np.flatnonzero(size >= least):
            yield t.slice(int(cut[i]), int(size[i]))
    if rest is not None and rest.num_rows >= least:
        yield rest


def estimates(n: np.ndarray, words: np.ndarray, i: int, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of set i to others by sketch, and where it may reach the threshold."""
    ratio = np.minimum(n[other], n[i]) / np.maximum(n[other], n[i])
    est = 1 - 2 * np.bitwise_count(words[other] ^ words[i]).sum(1) / BINS
    noise = 3.5 * np.sqrt(threshold * (1 - threshold) / np.minimum(np.minimum(n[other], n[i]), BINS / 2))
    return est, (ratio >= threshold) & (est >= threshold - noise)


def unique_rows(k: np.ndarray, n: np.ndarray, bits: np.ndarray):
    order = np.argsort(k, kind="stable")
    order = order[np.r_[True, np.diff(k[order]) != 0]]
    return order, k[order], n[order].astype(np.float64), bits[order].view(np.uint64)


def tie(k: np.ndarray, n: np.ndarray, bits: np.ndarray, threshold: float, sure: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First pass over a bucket: pairs of leaders and what resembles them, the leaders' places, and those of rows with any likeness.

    The leader is the row nearest to the majority of the sketches that are left, so a text with many variants leads
    them; rows that surely resemble it leave with it.
    """
    order, k, n, words = unique_rows(k, n, bits)
    a, b, leaders, left = [], [], [], np.arange(len(k))
    alike = np.zeros(len(k), bool)
    for i in range(len(k)):
        if not alike[i] and len(k) > 1:
            _, near = estimates(n, words, i, left, threshold)
            near[i] = False
            alike |= near
            alike[i] = near.any()
    left = left[alike]
    while len(left):
        if len(left) > 2:
            ones = np.unpackbits(words[left].view(np.uint8).reshape(len(left), -1), axis=1).mean(0) >= 0.5
            p = left[np.bitwise_count(words[left] ^ np.packbits(ones).view(np.uint64)).sum(1).argmin()]
        else:
            p = left[0]
        left = left[left != p]
        leaders.append(order[p])
        if not len(left):
            break
        est, near = estimates(n, words, p, left, threshold)
        surely = near & (est >= threshold + sure)
        if a and len(left) > 1:  # the first leader is tried with all that it may resemble, later ones with what they surely do
            near = surely
        a.append(np.full(near.sum(), k[p]))
        b.append(k[left[near]])
        left = left[~surely]
    none = np.zeros(0, np.int64)
    lone = order[~alike]
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.r_[np.array(leaders, np.int64), lone], order[alike]


def cross(k: np.ndarray, root: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Second pass: links between groups within one bucket, by brute force on the sets; one link joins two groups, as more change nothing."""
    _, first = np.unique(k, return_index=True)
    k, root, sets = k[first], root[first], [sets[i] for i in first]
    size = np.array([len(x) for x in sets])
    names, count = np.unique(root, return_counts=True)
    small = np.flatnonzero(root != names[count.argmax()])
    small = small[np.argsort(root[small], kind="stable")]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(k)), size)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    group = dict(zip(names.tolist(), names.tolist()))

    def top(r):
        while group[r] != r:
            r = group[r]
        return r

    out = []
    for i in small:
        lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        inter = np.bincount(owner[at], minlength=len(k))
        for j in np.flatnonzero((root != root[i]) & (inter / (size + size[i] - inter) >= threshold)):
            x, y = top(root[i]), top(root[j])
            if x != y:
                group[max(x, y)] = min(x, y)
                out.append((int(k[i]), int(k[j])))
    return out


MEMBER = "a long, b long, home long, path long, k long"


def sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(t.num_rows, -1)


def first_pass(threshold: float, leaders: bool = False):
    """Pairs (a, b) of every bucket, and its members (path, k) that resemble another; with ``leaders`` also its leaders (a = b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            a, b, home, path, k = (np.concatenate(c) for c in zip(*held))
            member = path != 0
            column = lambda x, ok: pa.array(x, pa.int64(), mask=~ok)
            return pa.record_batch({"a": column(a, ~member), "b": column(b, ~member), "home": column(home, ~member), "path": column(path, member), "k": column(k, member)})

        size = 0
        for t in groups(batches, 1 if leaders else 2):
            k = t["k"].to_numpy()
            a, b, lead, alike = tie(k, t["n"].to_numpy(), sketches(t), threshold)
            if leaders:
                a, b = np.r_[a, k[lead]], np.r_[b, k[lead]]
            home = np.full(len(a), t["home"][0].as_py() if leaders else 0)
            path = t["path"][0].as_py() or 1
            m = len(alike)
            none, void = np.zeros(len(a), np.int64), np.zeros(m, np.int64)
            held.append((np.r_[a, void], np.r_[b, void], np.r_[home, void], np.r_[none, np.full(m, path)], np.r_[none, k[alike]]))
            size += len(a) + m
            if size > 50_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def second_pass(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            sets = [np.asarray(x.values) for x in t["s"].combine_chunks()]
            pairs = cross(t["k"].to_numpy(), t["root"].to_numpy(), sets, threshold)
            if pairs:
                a, b = zip(*pairs)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def longer(limit: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, k = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for i in range(len(k)):
                t = np.frombuffer(b.column(2)[i].as_py(), np.uint64)
                p = extend(path[i : i + 1], t, limit)[1].view(np.int64)
                if len(p):
                    yield pa.record_batch({"path": pa.array(p), "k": pa.array(np.full(len(p), k[i]))})

    return run


def over(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias("c")).where(f"c > {limit}")


def buckets(reps: DataFrame, limit: int, splits: int, chosen: np.uint64) -> tuple[DataFrame, DataFrame | None]:
    """(path, k, n, bits) of all buckets within the limit, and (home, c, k, n, bits) of those that no path parts."""
    side = reps.select("k", "n", "bits")
    rows = reps.select(F.explode("paths").alias("path"), "k", "n", "bits")
    done, dense, big = [], None, over(rows, limit)
    for level in range(splits + 1):
        big = stored(big, "join-big")
        if big.isEmpty():
            break
        split = rows.join(big, "path")
        done.append(rows.join(big.select("path"), "path", "left_anti"))
        rows = None
        if level == splits:  # near copies, which share all tokens
            dense = split.select(F.col("path").alias("home"), "c", "k", "n", "bits")
            break
        more = split.select("path", "k").join(reps.select("k", "toks"), "k").select("path", "k", "toks").mapInArrow(longer(chosen), "path long, k long")
        rows = stored(more, "join-split").join(side, "k").select("path", "k", "n", "bits")
        big = over(rows, limit)
    every = [*done, rows] if rows is not None else done
    out = every[0]
    for d in every[1:]:
        out = out.unionByName(d)
    return out, dense


def by_path(df: DataFrame) -> DataFrame:
    return df.repartition("path").sortWithinPartitions("path")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dense_rounds(dense: DataFrame, side: DataFrame, threshold: float, limit: int) -> tuple[list[DataFrame], list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """Buckets over the limit: chunks are reduced to their leaders, which meet again, until they fit or stop shrinking; then chunks meet pairwise.

    Returns pairs found, the chunks (path, k) whose members the second pass compares, and of each round its chunks
    (home, path, k) and what left with which leader (home, a, b).
    """
    pairs, met, rounds, now = [], [], [], stored(dense, "join-dense")
    chunk = F.pmod(F.xxhash64("home", "k"), F.ceil(F.col("c") / limit))
    while not now.isEmpty():
        keyed = now.select(F.xxhash64("home", chunk).alias("path"), "k", "n", "bits", "home")
        found = stored(by_path(keyed).mapInArrow(first_pass(threshold, True), MEMBER), "join-lead")
        pairs.append(found.where("a is not null").select("a", "b"))
        met.append(found.where("k is not null").select("path", "k"))
        rounds.append((keyed.select("home", "path", "k"), found.where("a <> b").select("home", "a", "b")))
        lead = found.where("a = b").select("home", F.col("a").alias("k")).distinct()
        sizes = lead.groupBy("home").agg(F.count("*").alias("c2"))
        state = stored(now.select("home", "c").distinct().join(sizes, "home").where(f"c > {limit}"), "join-size")
        if state.isEmpty():
            break
        back = stored(lead.join(side, "k"), "join-leaders")
        stuck = state.where(f"c2 > {limit} and c2 > 0.7 * c")
        both = back.join(stuck, "home").withColumn("m", F.ceil(F.col("c2") / limit).cast("int")).withColumn("x", F.pmod(F.xxhash64("k"), F.col("m")).cast("int"))
        met.append(both.select(F.explode(F.expr("transform(sequence(0, m - 1), y -> xxhash64(home, least(x, y), greatest(x, y), 7))")).alias("path"), "k"))
        go = state.where(f"not (c2 > {limit} and c2 > 0.7 * c)")
        now = stored(back.join(go.select("home", F.col("c2").alias("c")), "home").select("home", "c", "k", "n", "bits"), "join-dense")
    return pairs, met, rounds


def parted(chunks: DataFrame, tied: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Buckets (path, k) for rows that left a dense bucket with a leader although the sets link them to none: each of them meets all chunks of its bucket."""
    group = lambda c: roots.select(F.col("k").alias(c), F.col("root").alias(f"{c}_root"))
    both = tied.join(group("a"), "a", "left").join(group("b"), "b", "left")
    lost = both.groupBy("home", "b").agg(F.max(F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False))).alias("linked")).where("not linked")
    lost = stored(lost.select("home", F.col("b").alias("k")), "join-lost")
    if lost.isEmpty():
        return None
    path = F.xxhash64("path", F.lit("lost")).alias("path")
    every = chunks.join(lost.select("home").distinct(), "home", "left_semi")
    return every.select(path, "k").unionByName(every.select("home", "path").distinct().join(lost, "home").select(path, "k"))


def unjoined(chunks: DataFrame, roots: DataFrame, limit: int) -> DataFrame | None:
    """Rows (path, k, root) of dense buckets for a last comparison: every row outside of a bucket's largest group, in parts of about ``limit``, meets every chunk.

    So all pairs of a dense bucket that nothing joins yet are compared, whatever leaders they left with; rows of the largest group are joined to each
    other. A task holds a chunk and a part. None if each bucket is one group, as near copies are.
    """
    own = stored(chunks.join(roots, "k", "left").select("home", "path", "k", F.coalesce("root", "k").alias("root")), "join-dense-roots")
    main = own.groupBy("home", "root").agg(F.count("*").alias("c")).groupBy("home").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rest = own.join(main, "home").where("root <> main").select("home", "k", "root")
    size = rest.groupBy("home").agg(F.ceil(F.count("*") / limit).alias("parts"))
    rest = stored(rest.join(size, "home").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts"))), "join-rest")
    if rest.isEmpty():
        return None
    path = F.xxhash64("path", "part", F.lit("rest")).alias("path")
    every = own.join(size, "home").select("path", "k", "root", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    guests = own.select("home", "path").distinct().join(rest, "home").select("path", "k", "root", "part")
    return every.unionByName(guests).select(path, "k", "root").distinct()


def set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for b in batches:
            ks, sets = [], []
            for text in b.column(0):
                u = shingle(text.as_py())
                ks.append(xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63) if len(u) else None)
                sets.append(u.view(np.int64))
            yield pa.record_batch({"k": pa.array(ks, pa.int64()), "s": pa.array(sets, pa.list_(pa.int64()))})

    return run


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs with their common share, exactly, where it reaches the threshold."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    return both.where(F.col("i") / F.col("u") >= threshold).select("a", "b", (F.col("i") / F.col("u")).alias("j"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``k, root``: the least key of each connected group, by least neighbours and pointer jumps; nothing is collected."""
    both = stored(edges.select(F.col(a).alias("k"), F.col(b).alias("o")).unionByName(edges.select(F.col(b).alias("k"), F.col(a).alias("o"))), "cc-edges")
    label = stored(both.groupBy("k").agg(F.least(F.col("k"), F.min("o")).alias("root")), "cc")
    while True:
        far = label.select(F.col("k").alias("o"), F.col("root").alias("r"))
        low = both.join(far, "o").groupBy("k").agg(F.min("r").alias("m")).join(label, "k").select("k", F.least("m", "root").alias("r1"), F.col("root").alias("was"))
        low = stored(low, "cc")
        jump = low.select(F.col("k").alias("r1"), F.col("r1").alias("r2"))
        new = stored(low.join(jump, "r1", "left").select("k", F.least("r1", F.coalesce("r2", "r1")).alias("root"), "was"), "cc")
        if new.where("root <> was").isEmpty():
            return new.select("k", "root")
        label = new.select("k", "root")


def count_links(threshold: float):
    """Weighted links within groups (key; side 0 against side 1, or side 0 within itself when no row has side 1)."""

    def member(sets: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(sets)
        _, col = np.unique(flat, return_inverse=True)
        m = np.zeros((len(sets), int(col.max(initial=0)) + 1), np.float32)
        m[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), col] = 1
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            side, k, w = t["side"].to_numpy(), t["k"].to_numpy(), t["w"].to_numpy()
            sets = [np.asarray(s.values) for s in t["s"].combine_chunks()] if t.num_rows else []
            size = np.array([len(s) for s in sets])
            m = member(sets)
            a = np.flatnonzero(side == 0)
            b = np.flatnonzero(side == 1)
            other = b if len(b) else a
            inter = m[a] @ m[other].T
            link = inter / (size[a][:, None] + size[other][None, :] - inter) >= threshold
            if not len(b):
                np.fill_diagonal(link, False)
            out = [(k[a], link @ w[other])]
            if len(b):
                out.append((k[b], link.T @ w[a]))
            ks, ls = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            yield pa.record_batch({"k": pa.array(ks, pa.int64()), "links": pa.array(ls.astype(np.int64), pa.int64())})

    return run


def link_counts(members: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """``k, links`` of all members ``(k, root, w)`` of groups: how many weighted others reach the threshold.

    Groups up to ``block`` sets are compared whole. Larger ones are cut by distance to the group's centre: two
    blocks whose distances add up to at most 1 - threshold are linked without a look, two whose distances differ
    by more than that are not linked at all, the rest are compared block against block.
    """
    reach = 1 - threshold
    size = members.groupBy("root").agg(F.count("*").alias("c"))
    sized = stored(members.join(size, "root"), "join-members")
    schema = "k long, links long"
    whole = sized.where(f"c <= {block}").join(sets, "k").select(F.col("root").alias("pair"), F.lit(0).alias("side"), "k", "w", "s")
    counts = whole.repartition("pair").sortWithinPartitions("pair").mapInArrow(count_links(threshold), schema)
    large = sized.where(f"c > {block}")
    if large.isEmpty():
        return counts
    far = large.join(sets, "k").join(sets.select(F.col("k").alias("root"), F.col("s").alias("z")), "root")
    far = far.withColumn("i", F.size(F.array_intersect("s", "z"))).withColumn("d", 1 - F.col("i") / (F.size("s") + F.size("z") - F.col("i")))
    steps = 40
    rough = stored(far.select("k", "root", "w", "d", F.floor(F.col("d") * steps).cast("int").alias("ring")), "join-rings")
    rings = rough.groupBy("root", "ring").agg(F.count("*").alias("c"))
    cut = stored(rough.join(rings, ["root", "ring"]).select("k", "root", "w", "d", F.struct("ring", F.pmod(F.xxhash64("k"), F.ceil(F.col("c") / block)).cast("int").alias("part")).alias("at")), "join-blocks")
    blocks = stored(cut.groupBy("root", "at").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("w").alias("w")), "join-block")
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.expr("x.root = y.root")).where(f"x.lo - y.hi <= {reach} + 1e-9 and y.lo - x.hi <= {reach} + 1e-9")
    pairs = stored(pairs.select(F.expr("x.root as root"), F.expr("x.at as p"), F.expr("y.at as q"), F.expr(f"x.hi + y.hi <= {reach} - 1e-9").alias("sure"), F.expr("y.w as w")), "join-pairs")
    # sure pairs of blocks: everybody in p is linked to all of q (but itself)
    sure = pairs.where("sure").groupBy("root", "p").agg(F.sum("w").alias("s"), F.max(F.expr("p = q")).alias("own"))
    given = cut.join(sure, (cut["root"] == sure["root"]) & (cut["at"] == sure["p"])).select("k", (F.col("s") - F.when(F.col("own"), F.col("w")).otherwise(0)).cast("long").alias("links"))
    open_ = pairs.where("not sure and (p.ring < q.ring or (p.ring = q.ring and p.part <= q.part))").select("root", "p", "q", F.xxhash64("root", "p", "q").alias("pair"))
    one = open_.select("root", F.col("p").alias("at"), "pair", F.lit(0).alias("side"))
    two = open_.where("p <> q").select("root", F.col("q").alias("at"), "pair", F.lit(1).alias("side"))
    rows = cut.join(one.unionByName(two), ["root", "at"]).join(sets, "k").select("pair", "side", "k", "w", "s")
    compared = rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(count_links(threshold), schema)
    return counts.unionByName(given).unionByName(compared).groupBy("k").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.995, bucket: int = 4096, splits: int = 2, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, n_links, copies`` for every row of ``docs``.

    ``class_id`` is the least id of the group that links of similarity ``threshold`` or more connect, ``n_links`` the
    number of other rows at least so similar (copies among them), ``copies`` the rows with the same set. Rows without
    words and rows with a null id link to nothing (a null id has a null class); repeated rows are copies of each other;
    extra columns are ignored; an empty table gives no rows; texts of any length count with all their shingles. Recall at the threshold, whatever it is, is ``recall`` for a
    pair that no third text connects, higher above it.
    """
    require(docs, id_col, text_col)
    runs, limit = runs_for(recall), choice(threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(base.mapInArrow(sketch_rows(n, runs, limit), f"id {kind}, k long, n int, bits binary, toks binary, paths array<long>"), "join-rows")
    reps = rows.where("k is not null and id is not null").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first(F.struct("n", "bits", "toks", "paths")).alias("x"))
    reps = stored(reps.select("k", "id", "w", "x.*"), "join-reps")
    rows_of, dense = buckets(reps, bucket, splits, limit)
    once = stored(by_path(rows_of).mapInArrow(first_pass(threshold), MEMBER), "join-first")
    pairs, members = [once.where("a is not null").select("a", "b")], [once.where("k is not null").select("path", "k")]
    rounds: list[tuple[DataFrame, DataFrame]] = []
    if dense is not None:
        more, met, rounds = dense_rounds(dense, reps.select("k", "n", "bits"), threshold, bucket)
        pairs, members = pairs + more, members + met
    # only these can be linked: their sets are made once
    used = members[0].select("k")
    for m in [*members[1:], *(chunks for chunks, _ in rounds)]:
        used = used.unionByName(m.select("k"))
    used = stored(used.distinct().join(reps.select("k", "id"), "k"), "join-used")
    texts = base.join(used.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(set_rows(n), "k long, s array<long>")
    sets = stored(texts.join(used.select("k"), "k", "left_semi").dropDuplicates(["k"]), "join-sets")
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    edges = stored(similar(ordered(found), sets, threshold), "join-edges")
    roots = components(edges)
    # second pass: brute force between the groups that a bucket holds and that nothing joins yet
    left = members[0]
    for m in [*members[1:], *filter(None, (parted(chunks, tied, roots) for chunks, tied in rounds))]:
        left = left.unionByName(m)
    left = stored(left.distinct().join(roots, "k", "left").select("path", "k", F.coalesce("root", "k").alias("root")), "join-members")
    open_ = left.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("path")
    tried = by_path(left.join(open_, "path").join(sets, "k").select("path", "k", "root", "s")).mapInArrow(second_pass(threshold), "a long, b long")
    more = stored(tried, "join-second")
    if not more.isEmpty():
        roots = components(edges.select("a", "b").unionByName(more))
    rest = unjoined(rounds[0][0], roots, bucket) if rounds else None
    if rest is not None:
        last = stored(by_path(rest.join(sets, "k").select("path", "k", "root", "s")).mapInArrow(second_pass(threshold), "a long, b long"), "join-last")
        if not last.isEmpty():
            roots = components(edges.select("a", "b").unionByName(more).unionByName(last))
    roots = stored(roots.join(reps.select("k", "id", "w"), "k"), "join-roots")
    links = link_counts(roots.select("k", "root", "w"), sets, threshold, block)
    least = roots.groupBy("root").agg(F.min("id").alias("class_id"))
    known = roots.select("k", "root").join(least, "root").join(links, "k", "left").select("k", "class_id", "links")
    every = reps.select("k", "id", "w").join(known, "k", "left").select("k", F.coalesce("class_id", "id").alias("class_id"), "w", F.coalesce("links", F.lit(0)).alias("links"))
    part = rows.select("id", F.when(F.col("id").isNotNull(), F.col("k")).alias("k")).join(every, "k", "left")
    out = part.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("w", F.lit(1)).cast("long").alias("copies"))
    return out


def one_of_each(docs: DataFrame, classes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are alone or bear their class's id, columns unchanged; of rows that repeat that id with the same text one stays. Rows with a null id stay.

    ``classes`` is a stored result of ``join``, as it is measured. Up to 16 MB of ids that go are broadcast, so texts don't move.
    """
    other = classes.where(f"`{id_col}` <> class_id").select(F.col(id_col).alias("__id")).distinct()
    kept = docs.join(small_side(other, "16 + coalesce(octet_length(cast(__id as string)), 0)"), F.col(id_col) == F.col("__id"), "left_anti")
    twice = classes.where(f"`{id_col}` is not null").groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("c")).where("c > 1").select("__id")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, F.col(id_col) == F.col("__id"), "left_anti").unionByName(again)
