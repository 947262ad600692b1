"""Context-mixing range coder for token ids, over many blocks at once.

A block is coded on its own from a fresh state. For each id four sources share the coder's range:

* order 2: the id that last followed the two ids before, if it proves right;
* order 1: the id that last followed the id before;
* order 0: the ids of the block so far, by how often they came, as of the last power of two of positions;
* a fixed falling distribution over the vocabulary, for ids that are new.

The shares are learned while coding, apart for each pair of confidences that orders 2 and 1 have earned and for whether
they agree. Blocks stand side by side as lanes of arrays: one step codes one id of every block, and encoder and decoder
make the same steps. The range coder keeps 60 bits and emits 16 at a time; carries are settled at the end.
"""

from __future__ import annotations

import numpy as np

WINDOW, LOW_BITS, WORD = 60, 44, 16
SHARE_BITS, FINE_BITS = 16, 20
SLOTS, CONTEXTS, FIRST_SNAPSHOT = 1024, 32, 64
SOURCES = 4


class Vocabulary:
    """The fixed distribution of ids: weight 1 / (id + 400), no id under 2**-20, in 2**20 parts."""

    def __init__(self, size: int):
        w = 1.0 / (np.arange(size) + 400.0)
        self.size = size
        self.share = (w / w.sum() * ((1 << FINE_BITS) - size)).astype(np.int64) + 1
        self.share[0] += (1 << FINE_BITS) - self.share.sum()
        self.start = np.cumsum(self.share) - self.share
        self.of_part = np.repeat(np.arange(size, dtype=np.int32), self.share)


def slot1(one: np.ndarray) -> np.ndarray:
    """Where order 1 looks after the id ``one``."""
    return (one * np.int32(40503) >> 5) & (SLOTS - 1)


def slot2(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where order 2 looks after ``two``, ``one``; products wrap around."""
    return ((two * np.int32(52711) + one) * np.int32(30341) >> 13) & (SLOTS - 1)


class Mixture:
    """Predictions of all lanes and what they learn."""

    def __init__(self, lanes: int):
        self.last = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]  # by order: predicted id << 2 | confidence
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.cell = np.arange(lanes, dtype=np.int64) * CONTEXTS
        self.row = np.arange(lanes, dtype=np.int64) * SOURCES
        c = np.arange(CONTEXTS)
        two, one = 4000 + 12000 * (c >> 3), 2000 + 4000 * (c >> 1 & 3)
        rest = (1 << SHARE_BITS) - two - one
        shares = np.tile(np.stack([two, one, rest // 2, rest - rest // 2], 1).astype(np.int32), (lanes, 1))
        self.shares = shares.reshape(-1).view(np.complex128)  # four shares of 32 bits move as one number
        self.edges = np.zeros((lanes, SOURCES), np.int32)

    def predict(self, slot1: np.ndarray, slot2: np.ndarray) -> None:
        n = len(slot1)
        self.at1, self.at2 = self.base[:n] + slot1, self.base[:n] + slot2
        self.e1, self.e2 = self.last[0].take(self.at1), self.last[1].take(self.at2)
        self.id1, self.id2 = self.e1 >> 2, self.e2 >> 2
        self.sure1, self.sure2 = self.e1 & 3, self.e2 & 3
        self.context = self.cell[:n] + ((self.sure2 << 3) + (self.sure1 << 1) + (self.id1 == self.id2))
        self.flat = self.shares.take(self.context).view(np.int32)
        share = self.flat.reshape(-1, SOURCES)
        edges = self.edges[:n]
        edges[:, 1] = share[:, 0]
        np.add(edges[:, 1], share[:, 1], out=edges[:, 2])
        np.add(edges[:, 2], share[:, 2], out=edges[:, 3])

    def of(self, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the source's share starts, the share), in fine parts."""
        self.pick = self.row[: len(source)] + source
        return self.edges.reshape(-1).take(self.pick).astype(np.int64) << FINE_BITS, self.flat.take(self.pick).astype(np.int64) << FINE_BITS

    def learn(self, x: np.ndarray) -> None:
        """``x`` came, coded by the source asked last: its share grows by a 32nd of the others', predictions that held gain confidence."""
        part = self.flat >> 5
        self.flat -= part
        p = part.reshape(-1, SOURCES)
        self.flat[self.pick] += p[:, 0] + p[:, 1] + p[:, 2] + p[:, 3]
        self.shares[self.context] = self.flat.view(np.complex128)
        fresh = x << 2
        for table, at, e, known, sure in ((self.last[0], self.at1, self.e1, self.id1, self.sure1), (self.last[1], self.at2, self.e2, self.id2, self.sure2)):
            table[at] = np.where(known == x, e + (sure < 3), np.where(sure > 0, e - 1, fresh))


def snapshot(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of a lane in order, where each one's run starts, the run's length), by row of ``seen``."""
    ids = np.sort(seen, axis=1)
    place = np.arange(ids.shape[1], dtype=np.int32)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    start = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    end = np.ones(ids.shape, bool)
    end[:, :-1] = new[:, 1:]
    stop = np.minimum.accumulate(np.where(end, place, ids.shape[1])[:, ::-1], axis=1)[:, ::-1]
    return ids, start.astype(np.int32), (stop - start + 1).astype(np.int32)


def by_length(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes longest first, and how many are still open at each step."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")


def spots(x: np.ndarray, seen: int, upto: int, size: int, lanes: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For the ids of columns ``seen`` to ``upto``: where their run starts in the lane's snapshot of the first ``seen`` columns (or -1), and the run's length; by column."""
    at = np.empty((upto - seen, len(x)), np.int16)
    runs = np.empty_like(at)
    where = np.empty((lanes, size), np.int16)
    for i in range(0, len(x), lanes):
        part = x[i : i + lanes]
        row = np.arange(len(part))[:, None]
        ids, start, run = snapshot(part[:, :seen])
        where[: len(part)].fill(-1)
        where[row, ids] = start
        got = where[row, part[:, seen:upto]]
        at[:, i : i + len(part)] = got.T
        runs[:, i : i + len(part)] = run[row, np.maximum(got, 0)].T
    return at, runs


def encode(blocks: list[np.ndarray], vocabulary: Vocabulary) -> list[bytes]:
    """Each block's ids as 16-bit words, most significant bits first."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, open_ = by_length(sizes)
    n, steps = len(blocks), len(open_)
    x = np.zeros((n, steps), np.int32)
    for lane, b in enumerate(order):
        x[lane, : sizes[b]] = blocks[b]
    rows = np.zeros((steps + 2, n), np.int32)  # two zeros come before a block
    rows[2:] = x.T
    m = Mixture(n)
    low, span, written = np.zeros(n, np.int64), np.full(n, 1 << WINDOW, np.int64), np.zeros(n, np.int64)
    words = np.zeros((2 * steps + 8, n), np.int32)  # with carries, so over 16 bits until the end
    flat = words.reshape(-1)
    lane = np.arange(n, dtype=np.int64)
    spot, runs, bits, taken = None, None, 0, 0
    none = np.full(n, -1, np.int16)
    for t in range(steps):
        a = int(open_[t])
        if t >= FIRST_SNAPSHOT and t & (t - 1) == 0:
            spot, runs = spots(x[:a], t, min(2 * t, steps), vocabulary.size)
            bits, taken = t.bit_length() - 1, t
        if t % 64 == 0:
            u = min(t + 64, steps)
            s1, s2 = slot1(rows[t + 1 : u + 1]), slot2(rows[t + 1 : u + 1], rows[t:u])
        now = rows[t + 2][:a]
        m.predict(s1[t % 64][:a], s2[t % 64][:a])
        at = spot[t - taken][:a] if taken else none[:a]
        source = np.where(at >= 0, 2, 3)
        source[m.id1 == now] = 1
        source[m.id2 == now] = 0
        edge, width = m.of(source)
        k = np.flatnonzero(source == 2)
        if len(k):
            unit = width.take(k) >> bits
            edge[k] += unit * at.take(k)
            width[k] = unit * runs[t - taken].take(k)
        k = np.flatnonzero(source == 3)
        unit, got = width.take(k) >> FINE_BITS, now.take(k)
        edge[k] += unit * vocabulary.start.take(got)
        width[k] = unit * vocabulary.share.take(got)
        r = span[:a] >> (SHARE_BITS + FINE_BITS)
        low[:a] += r * edge
        np.multiply(r, width, out=span[:a])
        k = np.flatnonzero(span[:a] < 1 << LOW_BITS)
        while len(k):
            w, l, s = written.take(k), low.take(k), span.take(k) << WORD
            flat[w * n + k] = l >> LOW_BITS
            written[k] = w + 1
            low[k] = (l & ((1 << LOW_BITS) - 1)) << WORD
            span[k] = s
            k = k[s < 1 << LOW_BITS]
        m.learn(now)
    for _ in range(4):
        flat[written * n + lane] = low >> LOW_BITS
        written += 1
        low = (low & ((1 << LOW_BITS) - 1)) << WORD
    for j in range(int(written.max()) - 1, 0, -1):
        words[j - 1] += words[j] >> WORD
    out: list[bytes] = [b""] * n
    columns = np.ascontiguousarray(words[: int(written.max())].astype(">u2").T)  # keeps the low 16 bits
    for i, b in enumerate(order):
        out[b] = columns[i, : written[i]].tobytes()
    return out


def decode(coded: list[bytes], sizes: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of blocks of these sizes."""
    if not coded:
        return []
    order, open_ = by_length(sizes)
    n, steps = len(coded), len(open_)
    longest = max(len(c) // 2 for c in coded)
    raw = np.zeros((longest + 6, n), np.uint16)
    for lane, b in enumerate(order):
        w = np.frombuffer(coded[b], ">u2")
        raw[: len(w), lane] = w
    head = raw[:4].astype(np.int64)
    off = head[0] << 44 | head[1] << 28 | head[2] << 12 | head[3] >> 4
    follow = ((raw[3:-1] & 15) << 12 | raw[4:] >> 4).reshape(-1)  # the words after the first 60 bits
    del raw
    span, taken_words = np.full(n, 1 << WINDOW, np.int64), np.zeros(n, np.int64)
    x = np.zeros((steps + 2, n), np.int32)
    m = Mixture(n)
    ids = start = runs = None
    bits, taken = 0, 0
    for t in range(steps):
        a = int(open_[t])
        if t >= FIRST_SNAPSHOT and t & (t - 1) == 0:
            ids, start, runs = np.empty((3, a, t), np.int32)
            for i in range(0, a, 256):
                ids[i : i + 256], start[i : i + 256], runs[i : i + 256] = snapshot(x[2 : t + 2, i : min(i + 256, a)].T)
            ids, start, runs = ids.reshape(-1), start.reshape(-1), runs.reshape(-1)
            bits, taken = t.bit_length() - 1, t
        one = x[t + 1][:a]
        m.predict(slot1(one), slot2(one, x[t][:a]))
        r = span[:a] >> (SHARE_BITS + FINE_BITS)
        v = off[:a] // r
        top = v >> FINE_BITS
        source = (top >= m.edges[:a, 1]).astype(np.int64)
        source += top >= m.edges[:a, 2]
        source += top >= m.edges[:a, 3]
        edge, width = m.of(source)
        now = np.where(source == 0, m.id2, m.id1)
        k = np.flatnonzero(source == 2)
        if len(k):
            unit, e = width.take(k) >> bits, edge.take(k)
            spot = k * taken + (v.take(k) - e) // unit
            now[k] = ids.take(spot)
            edge[k] = e + unit * start.take(spot)
            width[k] = unit * runs.take(spot)
        k = np.flatnonzero(source == 3)
        unit, e = width.take(k) >> FINE_BITS, edge.take(k)
        got = vocabulary.of_part.take((v.take(k) - e) // unit)
        now[k] = got
        edge[k] = e + unit * vocabulary.start.take(got)
        width[k] = unit * vocabulary.share.take(got)
        off[:a] -= r * edge
        np.multiply(r, width, out=span[:a])
        k = np.flatnonzero(span[:a] < 1 << LOW_BITS)
        while len(k):
            w, s = taken_words.take(k), span.take(k) << WORD
            off[k] = off.take(k) << WORD | follow.take(w * n + k).astype(np.int64)
            taken_words[k] = w + 1
            span[k] = s
            k = k[s < 1 << LOW_BITS]
        x[t + 2][:a] = now
        m.learn(now)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    columns = np.ascontiguousarray(x[2:].T)
    for lane, b in enumerate(order):
        out[b] = columns[lane, : sizes[b]]
    return out
