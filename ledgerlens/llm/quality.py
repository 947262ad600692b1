"""Quality classifier: a byte-level convolutional network written in numpy.

Bytes are embedded, windows of eight bytes (every four, so they overlap) pass through learned filters,
and each chunk of windows, chunks overlapping by half and covering the whole text, is max-pooled. A
hidden layer scores every chunk; the chunk vectors' mean and maximum over the document give one
probability. Training is Adam on the cross-entropy, with fixed seed and order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import crc_mod, require

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 8, 32, 16
CHUNK, STEP = 64, 32  # windows in a chunk, windows between chunk starts
SLICE = 1 << 17  # windows that are convolved at once
NAMES = ("emb", "conv", "bias", "hid", "hbias", "out", "obias")


def start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    made = {
        "emb": r.normal(0, 0.5, (256, EMBED)), "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
        "hid": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "hbias": np.full(HIDDEN, 0.1), "out": r.normal(0, 0.2, 2 * HIDDEN), "obias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def grid(raw: np.ndarray) -> np.ndarray:
    """The bytes, padded with zeros to whole windows."""
    n = max(1, -(-(len(raw) - WIDTH) // STRIDE) + 1)
    return np.concatenate([raw, np.zeros((n - 1) * STRIDE + WIDTH - len(raw), np.uint8)])


def responses(data: np.ndarray, p: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Filter responses of all windows, a slice at a time in whole steps, so memory doesn't grow with the text; the last is padded."""
    windows = (len(data) - WIDTH) // STRIDE + 1
    for at in range(0, windows, SLICE):
        n = min(SLICE, windows - at)
        piece = p["emb"][data[at * STRIDE : (at + n - 1) * STRIDE + WIDTH]].reshape(-1)
        rows = np.lib.stride_tricks.as_strided(piece, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
        act = rows @ p["conv"]
        pad = -n % STEP
        if pad:
            act = np.concatenate([act, np.full((pad, FILTERS), -np.inf, np.float32)])
        yield act.reshape(-1, STEP, FILTERS)


def pooled(raw: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Max-pooled filter responses of every chunk of one text."""
    half = np.concatenate([act.max(1) for act in responses(grid(raw), p)])
    both = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
    return np.maximum(both + p["bias"], 0)


def score_text(raw: bytes, p: dict[str, np.ndarray]) -> float:
    chunks = pooled(np.frombuffer(raw, np.uint8), p)
    h = np.maximum(chunks @ p["hid"] + p["hbias"], 0)
    z = float(np.concatenate([h.mean(0), h.max(0)]) @ p["out"] + p["obias"][0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def strongest(data: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every chunk and filter the greatest response and its window."""
    top, arg, at = [], [], 0
    for act in responses(data, p):
        best = act.argmax(1)
        top.append(np.take_along_axis(act, best[:, None], 1)[:, 0])
        arg.append(best + (at + np.arange(len(act)) * STEP)[:, None])
        at += act.shape[0] * STEP
    top, arg = np.concatenate(top), np.concatenate(arg)
    if len(top) > 1:
        later = top[1:] > top[:-1]
        top, arg = np.where(later, top[1:], top[:-1]), np.where(later, arg[1:], arg[:-1])
    return top, arg


def gradients(raws: list[bytes], ys: np.ndarray, ws: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean gradient over whole texts; only the windows that won a chunk take part, a slice at a time."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for raw, y, w in zip(raws, ys, ws):
        data = grid(np.frombuffer(raw, np.uint8))
        best, arg = strongest(data, p)
        top = np.maximum(best + p["bias"], 0)
        pre = top @ p["hid"] + p["hbias"]
        h = np.maximum(pre, 0)
        peak = h.argmax(0)
        both = np.concatenate([h.mean(0), h[peak, np.arange(HIDDEN)]])
        z = np.clip(both @ p["out"] + p["obias"][0], -30, 30)
        d = np.float32(w * (1 / (1 + np.exp(-z)) - y))
        g["out"] += d * both
        g["obias"] += d
        dh = np.tile(d * p["out"][:HIDDEN] / len(h), (len(h), 1))
        np.add.at(dh, (peak, np.arange(HIDDEN)), d * p["out"][HIDDEN:])
        dh *= pre > 0
        g["hid"] += top.T @ dh
        g["hbias"] += dh.sum(0)
        dtop = (dh @ p["hid"].T) * (top > 0)
        g["bias"] += dtop.sum(0)
        used, inverse = np.unique(arg, return_inverse=True)
        dact = np.zeros((len(used), FILTERS), np.float32)
        np.add.at(dact, (inverse.reshape(arg.shape), np.arange(FILTERS)), dtop)
        for i in range(0, len(used), SLICE):
            ids, d_act = data[used[i : i + SLICE, None] * STRIDE + np.arange(WIDTH)], dact[i : i + SLICE]
            g["conv"] += p["emb"][ids].reshape(len(ids), -1).T @ d_act
            flat, add = ids.reshape(-1), (d_act @ p["conv"].T).reshape(-1, EMBED)
            g["emb"] += np.stack([np.bincount(flat, add[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
    return {k: v / len(raws) for k, v in g.items()}


def train(raws: list[bytes], labels: list[int], *, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after Adam over the samples; the classes weigh alike. Without both classes the score is the share of ones."""
    p, y = start(seed), np.array(labels, np.float32)
    ones = float(y.sum())
    if not 0 < ones < len(y):
        p["out"][:] = 0
        p["obias"][:] = 0.0 if not len(y) else (4.0 if ones else -4.0)
        return p
    w = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones))).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    r, t = np.random.default_rng(seed), 0
    steps = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            g, t = gradients([raws[k] for k in pick], y[pick], w[pick], p), t + 1
            for k in NAMES:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                p[k] -= (rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, sample: int = 3000, sample_bytes: int = 64_000_000, epochs: int = 6) -> dict[str, np.ndarray]:
    """Train on a bounded sample of labelled rows outside the held-out fold: those of least hashed id, ``sample`` rows and ``sample_bytes`` of text at most.

    Training texts are whole. Rows with a null id, text or label are left out; of repeated labels the least counts, of
    texts that repeat an id the least. Empty tables give a model that scores 0.5.
    """
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = y.where(crc_mod("doc_id", folds) != held)
    chosen = y.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("h", "doc_id").agg(F.max(F.octet_length("text")).alias("n")).orderBy("h", "doc_id").collect()  # ``sample`` rows at most
    room, last = sample_bytes, None
    for r in sizes:
        room -= r["n"]
        if room < 0:
            break
        last = r["h"]
    if last is None:
        return train([], [], epochs=epochs)
    got = rows.where(F.col("h") <= last).groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")).orderBy("h", "doc_id").collect()
    return train([r["text"].encode() for r in got], [r["quality"] for r in got], epochs=epochs)


def quality_scores(docs: DataFrame, weights: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """``id``, the columns in ``keep`` and ``score_col`` for every row, from the whole text's bytes alone.

    One map pass, no shuffle; a text of any length is read in chunks that overlap, to its end. A null text scores as the empty text; a null id stays; repeated rows repeat; an empty
    table gives no rows; other columns are ignored, and one in ``keep`` may not be named as the score.
    """
    require(docs, id_col, text_col)
    held = [id_col, *keep]
    if score_col.lower() in [c.lower() for c in held]:
        raise ValueError(f"{score_col} is kept: name the score otherwise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [score_text(x.as_buffer().to_pybytes() if x.is_valid else b"", weights) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in held) + f", `{score_col}` double"
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw")
    return docs.select(*held, raw).mapInArrow(run, schema)
