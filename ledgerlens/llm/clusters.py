"""Integer k-means by partial-distance search.

A vector's squared distance to a centroid is summed over the dimensions of greatest variance first, in integers. The best
centroid by the first dimensions gives the vector a whole distance to beat; a centroid is left as soon as its partial sum
is strictly above the best distance known, so ties stay in and go to the smaller number; survivors finish all dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, stored

STEP = 8
#: Components under this keep every squared distance of 64 dimensions within a long.
LARGEST = 1 << 27


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """id, v: vectors of ``dim`` components, none null or non-finite, as floor(scale * x). One too large for exact distances is an error."""
    ok = F.expr(f"size({vec_col}) = {dim} and not exists({vec_col}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))")
    clean = df.where(F.col(vec_col).isNotNull() & ok)
    x = f"floor({scale} * cast(x as double))"
    large = f"raise_error('a component of {LARGEST} or more after scaling')"
    whole = F.expr(f"transform({vec_col}, x -> cast(case when abs({x}) < {LARGEST} then {x} else {large} end as int))")
    return clean.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; dimensions are taken in the given order."""
    x, c = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    n, dim = x.shape
    partial = np.zeros((n, len(c)), np.int64)
    for d in range(min(STEP, dim)):
        partial += (x[:, d, None] - c[None, :, d]) ** 2
    guess = partial.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    row, number = np.nonzero(partial <= best[:, None])
    total = partial[row, number]
    for d in range(STEP, dim, STEP):
        diff = x[row, d : d + STEP] - c[number, d : d + STEP]
        total = total + (diff * diff).sum(1)
        alive = total <= best[row]
        row, number, total = row[alive], number[alive], total[alive]
    # survivors have whole distances; the guess is always among them
    first = np.lexsort((number, total, row))
    row, number, total = row[first], number[first], total[first]
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return number[head], total[head]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """cluster, n, sum of each centroid's nearest vectors; one row a cluster and task is shuffled."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                x = matrix(b.column(0).slice(i, 4096), dim)
                near, _ = nearest(x, centroids, order)
                by = np.argsort(near, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(near[by]) > 0])
                total[near[by][edge]] += np.add.reduceat(x[by].astype(np.int64), edge)
                n += np.bincount(near, minlength=k)
        has = np.flatnonzero(n)
        if len(has):
            yield pa.record_batch({"cluster": pa.array(has, pa.int32()), "n": pa.array(n[has]), "s": pa.array(list(total[has]), pa.list_(pa.int64()))})

    part = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(dim)]).alias("s"))


def clusters(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    The vectors of least sha256 of ``salt`` and id are the first centroids; each round assigns all vectors and moves each
    centroid with vectors to the floor of their mean; a last assignment follows. Vectors that are null, of another length or
    hold null or non-finite components are left out; a null id's hash is that of the salt alone; repeated rows count as the vectors they are, and
    may be several centroids; with fewer than ``k`` vectors each is a centroid; an empty table gives no rows; other
    columns are ignored. Components of 2**27 or more after scaling are an error, as distances would pass a long.

    The driver holds ``k`` centroids and sums, nothing that grows with the vectors. A round reads the stored vectors
    once and shuffles ``k`` rows a task.
    """
    require(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    schema = "cluster int, distance long"
    v = stored(kept_vectors(vectors, id_col, vec_col, dim, scale), "clusters")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = v.orderBy(digest, "id", "v").limit(k).select("v").collect()
    if not start:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spread = v.agg(*[F.var_pop(F.col("v")[j]) for j in range(dim)]).first()
    order = np.argsort([-(s or 0.0) for s in spread], kind="stable")
    centroids = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        for r in sums(v, centroids, order).collect():
            centroids[r["cluster"]] = np.array(r["s"], np.int64) // r["n"]
    final = centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                near, distance = nearest(matrix(b.column(1).slice(i, 4096), dim), final, order)
                yield pa.record_batch({"id": b.column(0).slice(i, 4096), "cluster": pa.array(near, pa.int32()), "distance": pa.array(distance, pa.int64())})

    found = stored(v.select("id", "v").mapInArrow(run, f"id long, {schema}"), "clusters-found")
    told = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(final)]
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # k rows: sums of the clusters, of all, and the centroids' digests
    by = each.join(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(spark.createDataFrame(told, "cluster int, centroid_sha256 string")), "cluster")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same in DuckDB: each round a product of vectors and centroids, components as rows for the means."""
    near = (
        "SELECT i, c, d FROM (SELECT v.i, {m}.c, list_sum(list_transform(range(1, {dim} + 1), lambda j: (v.q[j] - {m}.q[j]) * (v.q[j] - {m}.q[j]))) d FROM v, {m}) "
        "QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1"
    )
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(m=f'm{r}', dim=dim)})")
        mean = f"SELECT c, j, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) x FROM (SELECT c, unnest(q) x, unnest(range(1, {dim} + 1)) j FROM a{r} JOIN v USING (i)) GROUP BY c, j"
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT m{r}.c, coalesce(n.q, m{r}.q) q FROM m{r} LEFT JOIN (SELECT c, list(x ORDER BY j) q FROM ({mean}) GROUP BY c) n ON n.c = m{r}.c)")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, q) - 1 c, q FROM (SELECT q, vec_id, sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')) h FROM v) QUALIFY row_number() OVER (ORDER BY h, vec_id, q) <= {k}),
{", ".join(steps)}, f AS MATERIALIZED ({near.format(m=f'm{rounds}', dim=dim)})
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m{rounds}.q, ',')) AS centroid_sha256 FROM f JOIN v USING (i) JOIN m{rounds} ON m{rounds}.c = f.c"""
