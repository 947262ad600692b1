"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are dealt in blocks of descending length. The first block gives every query a lower bound of its
k-th score; any other block is walked in order of length and left as soon as |q||x| falls below the bound
(Cauchy-Schwarz). For the rest the first rotated coordinates give a partial sum, and the lengths of what is
left bound the remainder; only survivors are scored in full, in integers. Bounds carry a rounding margin,
so no pruned vector can belong to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, small_side, stored

HEAD_DIMS = 16


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows that take part, with components floor(scale * x), their squared length and dimension."""
    ok = F.expr(f"size({vec_col}) > 0 and not exists({vec_col}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))")
    v = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), F.expr(f"transform({vec_col}, x -> floor({scale} * cast(x as double)))").alias("v"))
    return v.withColumn("dim", F.size("v")).withColumn("norm2", F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where those are exact."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if big < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search(qid, qrow, q, qbound, ids, rows, x, k, turn):
    """(query's id, its row, vector's id, score) of the top k of one block (by descending length) for a block of queries with lower bounds ``qbound``."""
    qf, xf = q.astype(np.float64) @ turn, x.astype(np.float64) @ turn
    qn, xn = np.sqrt((qf**2).sum(1)), np.sqrt((xf**2).sum(1))
    h = min(HEAD_DIMS, q.shape[1])
    qt, xt = np.sqrt((qf[:, h:] ** 2).sum(1)), np.sqrt((xf[:, h:] ** 2).sum(1))
    out = []
    for i0 in range(0, len(q), 256):
        part = slice(i0, min(i0 + 256, len(q)))
        slack = 1e-6 * (1 + qn[part] * (xn[0] if len(xn) else 0))
        # lengths fall along the block: the last row that any query of the slice may need
        reach = np.array([np.searchsorted(-xn, -(b - s) / n, side="right") if n > 0 and b - s > 0 else len(xn) for b, s, n in zip(qbound[part], slack, qn[part])])
        m = int(reach.max(initial=0))
        if not m:
            continue
        upper = qf[part, :h] @ xf[:m, :h].T + qt[part][:, None] * xt[None, :m]
        for j, i in enumerate(range(part.start, part.stop)):
            near = np.flatnonzero(upper[j, : reach[j]] >= qbound[i] - slack[j])
            near = near[rows[near] != qrow[i]]
            if len(near):
                s = dots(q[i : i + 1], x[near])[0]
                top = best(ids[near], s, k)
                out.append((np.full(len(top), qid[i]), np.full(len(top), qrow[i]), ids[near][top], s[top]))
    if not out:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(c) for c in zip(*out)]


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, query_block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products for every id divisible by ``every``.

    Each query row meets all rows but itself. Null vectors, and those with null or non-finite
    components, take no part, nor do null ids; only vectors of the query's dimension are comparable. Equal
    scores go to the smaller id; rows of one id count as the vectors they are: each is a query with ranks of its own, and a candidate of the
    others. An empty table gives no rows; texts don't matter and other columns are ignored whatever their names.
    Blocks of queries meet the blocks of vectors that their bounds leave; no task holds more than one block of each at a time.
    """
    require(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    clean = stored(quantised(vectors, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "topk")
    sizes = {r["dim"]: r["n"] for r in clean.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, query_row long, vec_id long, score long"
    results = []
    for dim, n in sorted(sizes.items()):
        mine = clean.where(F.col("dim") == dim)
        turn = rotation(mine, dim)
        n_blocks = max(1, -(-n // block))
        ranged = mine.repartitionByRange(n_blocks, F.desc("norm2"), "row").sortWithinPartitions(F.desc("norm2"), "row")
        packed = stored(ranged.select("id", "row", "v", "norm2").mapInArrow(packer(block), "block long, ids array<long>, rows array<long>, v array<long>, top double"), "topk-blocks")
        # the longest block serves first
        head = packed.orderBy(F.desc("top")).limit(1).collect()
        hrow = np.array(head[0]["rows"], np.int64)
        hv = np.array(head[0]["v"], np.int64).reshape(-1, dim)
        queries = mine.where(F.col("id") % every == 0).select("id", "row", "v").repartition(max(1, -(-(n // every) // query_block)), "row")
        bounded = stored(queries.mapInArrow(bounds(hrow, hv, dim, k), "at long, qids array<long>, qrows array<long>, q array<long>, low array<double>, qmax double"), "topk-queries")
        # bounds meet as numbers, a row a block; vectors follow only where a block of queries may need them
        asked = bounded.select("at", "qmax", F.array_min("low").alias("low"))
        near = F.sqrt("top") * F.col("qmax") * 1.000001 + 1 >= F.col("low")
        pairs = stored(packed.select("block", "top").join(small_side(asked, "32"), near).select("block", "at"), "topk-pairs")
        tasks = max(1, -(-pairs.count() // 4))
        joined = pairs.join(packed, "block").join(bounded, "at").select("ids", "rows", "v", "qids", "qrows", "q", "low").repartition(tasks)
        results.append(joined.mapInArrow(searcher(dim, k, turn), schema))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    ranked = found.groupBy("query_id", "query_row").agg(F.expr(f"slice(array_sort(collect_list(struct(-score as s, vec_id as v))), 1, {k})").alias("t"))
    return ranked.select("query_id", F.posexplode("t").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), (-F.col("t.s")).alias("score"))


def rotation(mine: DataFrame, dim: int, sample: int = 4096) -> np.ndarray:
    """Right singular vectors of at most ``sample`` vectors of least hashed id; any rotation keeps results exact, a good one prunes."""
    rows = mine.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    m = np.array([r["v"] for r in rows], np.float64).reshape(-1, dim)
    return np.linalg.svd(m, full_matrices=True)[2].T if dim <= 1024 else np.eye(dim)


def packer(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, made = TaskContext.get().partitionId(), 0

        def flush():
            nonlocal made
            made += 1
            ids = np.concatenate([x.column(0).to_numpy() for x in held])
            rows = np.concatenate([x.column(1).to_numpy() for x in held])
            v = np.concatenate([np.asarray(x.column(2).flatten()) for x in held])
            whole = {"ids": ids, "rows": rows, "v": v}
            return pa.record_batch({"block": pa.array([part << 32 | made], pa.int64())} | {c: pa.array([x], pa.list_(pa.int64())) for c, x in whole.items()} | {"top": pa.array([held[0].column(3)[0].as_py()], pa.float64())})

        for b in batches:
            while b.num_rows:
                room = block - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) >= block:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def bounds(hrow, hv, dim, k):
    """Blocks of queries with the k-th score that each has among the longest vectors, or -inf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            qid, qrow, q = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dim)
            low = np.full(len(qid), -np.inf)
            for i in range(len(qid)):
                s = dots(q[i : i + 1], hv)[0][hrow != qrow[i]]
                if len(s) >= k:
                    low[i] = np.partition(s, len(s) - k)[len(s) - k]
            longest = float(np.sqrt((q.astype(np.float64) ** 2).sum(1)).max())
            yield pa.record_batch({"at": pa.array([int(qrow[0])], pa.int64()), "qids": pa.array([qid], pa.list_(pa.int64())), "qrows": pa.array([qrow], pa.list_(pa.int64())), "q": pa.array([q.reshape(-1)], pa.list_(pa.int64())), "low": pa.array([low], pa.list_(pa.float64())), "qmax": pa.array([longest])})

    return run


def searcher(dim, k, turn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, rows, v, qids, qrows, q, low = (np.asarray(b.column(c)[i].values) for c in range(7))
                a, r, c, s = search(qids, qrows, q.reshape(-1, dim), low, ids, rows, v.reshape(-1, dim), k, turn)
                yield pa.record_batch({"query_id": pa.array(a, pa.int64()), "query_row": pa.array(r, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.int64())})

    return run
