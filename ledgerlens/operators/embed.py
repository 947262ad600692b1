"""Account embeddings with closed-form projection weights, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import weight
from ledgerlens.operators.flow import both_ends, neighbours, undirected
from ledgerlens.operators.forest import cut
from ledgerlens.operators.graph import beside
from ledgerlens.operators.order import sums_before


def project(columns: list[str], dim: int, seed: float, scale: float = 0.5):
    """Array of ``dim`` projections of the columns."""
    return F.array(*[sum((F.col(c) * weight(f"{i}", f"{j}", seed, scale) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(dim)])


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; one small pass."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns])
    return df.join(F.broadcast(stats)).select("account_id", *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"d_{c}") + 1e-9)).alias(c) for c in columns])


def han(accounts: DataFrame, features: DataFrame, *, dim: int = 16, columns: tuple[str, ...] = ("flow_ratio", "tps_score", "pagerank", "hawkes_intensity")) -> DataFrame:
    """account_id, embedding: attention over two metapaths. Accounts that share a customer or branch have equal rows in the
    metapath's matrix, so its product with the features is the mean over the group: two aggregations, no matrix. An account
    without a branch has an empty row there, so zeros."""
    cols = list(columns)
    x = accounts.select("account_id", "name", "branch").join(features.select("account_id", *cols), "account_id", "left").na.fill(0.0, cols)
    x = x.withColumn("customer", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("account_id")))
    z = cut(x.withColumn("h", project(cols, dim, 1.0)).select("account_id", "customer", "branch", "h"))
    paths = []
    for g in ("customer", "branch"):
        mean = z.where(F.col(g).isNotNull()).groupBy(g).agg(F.array(*[F.avg(F.col("h")[k]) for k in range(dim)]).alias(f"z_{g}"))
        z = z.join(mean, g, "left").withColumn(f"z_{g}", F.coalesce(f"z_{g}", F.array_repeat(F.lit(0.0), dim)))
        paths.append(f"z_{g}")
    q = [weight("0", f"{k}", 7.0, 1.0) for k in range(dim)]
    energy = [F.avg(sum((F.tanh(F.col(p)[k]) * q[k] for k in range(dim)), F.lit(0.0))).alias(f"e_{p}") for p in paths]
    att = z.agg(*energy)
    both = z.join(F.broadcast(att))
    top = F.greatest(*[F.col(f"e_{p}") for p in paths])
    w = [F.exp(F.col(f"e_{p}") - top) for p in paths]
    mixed = F.array(*[sum((w[i] * F.col(p)[k] for i, p in enumerate(paths)), F.lit(0.0)) / sum(w, F.lit(0.0)) for k in range(dim)])
    return both.select("account_id", mixed.alias("embedding"))


def tgat(edges: DataFrame, features: DataFrame, *, dim: int = 16, columns: tuple[str, ...] = ("in_volume", "out_volume", "pagerank", "hawkes_intensity")) -> DataFrame:
    """account_id, embedding: softmax attention over an account's timed edges, with a cosine time code; accounts without any keep their own half."""
    half, cols = dim // 2, list(columns)
    ids = features.select("account_id")
    h = cut(standardise(features.select("account_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), cols).select("account_id", project(cols, half, 2.0).alias("h")))
    b = both_ends(edges.where("us is not null")).select("account_id", F.when(F.col("out") == 1, F.col("dst")).otherwise(F.col("src")).alias("o"), "us")
    b = b.join(ids.withColumnRenamed("account_id", "o"), "o", "left_semi")
    last = b.groupBy("account_id").agg(F.max("us").alias("mx"))
    e = b.join(last, "account_id").withColumn("dh", (F.col("mx") - F.col("us")) / 3.6e9).join(h, "account_id").join(h.select(F.col("account_id").alias("o"), F.col("h").alias("g")), "o")
    freq = [10000.0 ** (-2.0 * i / dim) for i in range(half)]
    phi = [F.cos(F.col("dh") * f) for f in freq] + [F.sin(F.col("dh") * f) for f in freq]
    energy = sum((F.col("h")[k] * F.col("g")[k] * weight(f"{k}", f"{k}", 3.0, 1.0) for k in range(half)), F.lit(0.0)) + sum((phi[k] * weight(f"{k}", "0", 4.0, 0.1) for k in range(dim)), F.lit(0.0))
    e = e.select("account_id", energy.alias("en"), F.array(*[F.col("g")[k] for k in range(half)], *phi[:half]).alias("v"))
    top = e.groupBy("account_id").agg(F.max("en").alias("mx"))
    w = F.exp(F.col("en") - F.col("mx"))
    out = e.join(top, "account_id").groupBy("account_id").agg(F.array(*[F.sum(w * F.col("v")[k]) / F.sum(w) for k in range(dim)]).alias("z"))
    alone = F.concat("h", F.array_repeat(F.lit(0.0), dim - half))
    return h.join(out, "account_id", "left").select("account_id", F.coalesce("z", alone).alias("embedding"))


def numbered_links(links: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(nodes: k, i, at, d; links: g, i, j; their numbers), from links (k, o) both ways. ``i`` numbers the nodes in order, ``g`` the links by both
    ends; a node's ``d`` links are those from ``at`` on."""
    nodes, total = sums_before(links.groupBy("k").agg(F.count("*").alias("d")), [F.col("k")], {"i": F.lit(1), "at": F.col("d")})
    n = int(total["i"])
    nodes = cut(nodes.select("k", F.col("i").cast("int" if n < 1 << 31 else "long").alias("i"), "at", "d"))
    end = lambda c, i: beside(nodes.select(F.col("k").alias(c), F.col("i").alias(i)), n)
    ends = links.join(end("k", "i"), "k").join(end("o", "j"), "o").select("i", "j")
    return nodes, cut(sums_before(ends, [F.col("i"), F.col("j")], {"g": F.lit(1)})[0]), n, int(total["at"])


def walk_rows(links: DataFrame, window: int, samples: int, *, task_rows: int = 2_000_000, hub: int = 50_000) -> tuple[DataFrame, DataFrame, int, float]:
    """(nodes as in ``numbered_links``; i, j, v both ways; the number of nodes; the sum of degrees): see ``walk_weights``.

    A walk is a row of numbers that goes from step to step, with the places it came to; no step is stored. Counts are whole, in parts of 1 / (2 * samples).
    Rows are dealt by node, about ``task_rows`` a task, those of a node of over ``hub`` links over several tasks.
    """
    nodes, numbered, n, vol = numbered_links(links)
    adjacent = numbered.join(beside(nodes.select(F.col("i").alias("j"), "at", "d"), n), "j")
    walks, places = adjacent.select("i", F.col("g").alias("from"), "at", "d", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s")), []
    for step in range(2, window + 1):
        pick = (F.col("at") + F.pmod(F.xxhash64("from", "s", F.lit(step)), F.col("d"))).alias("pick")
        walks = walks.select(pick, "i", "from", "s", *places).join(adjacent.select(F.col("g").alias("pick"), F.col("j").alias(f"j{step}"), "at", "d"), "pick")
        places.append(f"j{step}")
    # a link is seen from both ends, and either direction of a walk estimates the same number: their mean
    seen = numbered.select("i", "j", F.lit(2 * samples).alias("c"))
    if places:
        ends = [F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for p in places for a, b in (("i", p), (p, "i"))]
        seen = seen.unionByName(walks.select(F.explode(F.array(*ends)).alias("e")).select("e.i", "e.j", F.lit(1).alias("c")))
    hubs = nodes.where(F.col("d") > hub).select("i", F.ceil(F.col("d") / hub).alias("parts"))
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vol * (1 + 2 * samples * (window - 1)) // task_rows))
    dealt = seen.join(F.broadcast(hubs), "i", "left").select("i", "j", "c", F.pmod(F.col("j"), F.coalesce("parts", F.lit(1))).alias("part")).repartition(parts, "i", "part")
    pair = dealt.groupBy("i", "part", "j").agg(F.sum("c").alias("c"))
    for c in ("i", "j"):
        pair = pair.join(beside(nodes.select(F.col("i").alias(c), F.col("d").alias(f"d{c}")), n), c)
    v = F.ln(F.col("c") / (2 * samples) * (float(vol) / window) / (F.col("di") * F.col("dj")))
    return nodes, pair.select("i", "j", v.alias("v")).where("v > 0"), n, float(vol)


def walk_weights(links: DataFrame, *, window: int = 3, samples: int = 4) -> tuple[DataFrame, float]:
    """(k, o, v for k <= o: the logarithm of the walks' co-occurrence over chance, where it is above 0; the sum of degrees), from links (k, o) both ways.

    Walks of one step are the links themselves. From each link ``samples`` walks go on to ``window`` steps, and each place they come
    to counts 1 / samples: without bias the walks of that length between the two ends, as many rows as links a step. A step
    picks a link of the place by its number in the order of all links, a key that no two links share, so hubs
    aren't hot; picks are hashes, so a task tried again makes the same.
    """
    nodes, rows, n, vol = walk_rows(links, window, samples)
    rows = rows.where("i <= j")
    for c, name in (("i", "k"), ("j", "o")):
        rows = rows.join(beside(nodes.select(F.col("i").alias(c), F.col("k").alias(name)), n), c)
    return rows.select("k", "o", "v"), vol


def gram(y: DataFrame, dim: int):
    """The dim x dim products of the columns of ``y``, one row a task summed on the driver."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            m = np.asarray(b.column(0).flatten()).reshape(-1, dim)
            g += m.T @ m
        yield pa.record_batch({"g": pa.array([g.ravel()], pa.list_(pa.float64()))})

    return sum((np.array(r["g"]).reshape(dim, dim) for r in y.select("y").mapInArrow(run, "g array<double>").collect()), np.zeros((dim, dim)))


def turned(y: DataFrame, t) -> DataFrame:
    """k, y: each row of ``y`` times the small matrix ``t``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(1).flatten()).reshape(-1, len(t)) @ t
            yield pa.record_batch({"k": b.column(0), "y": pa.array(list(m), pa.list_(pa.float64()))})

    return y.select("k", "y").mapInArrow(run, f"k {y.schema['k'].dataType.simpleString()}, y array<double>")


def netmf(edges: DataFrame, accounts: DataFrame, *, dim: int = 16, window: int = 3, iterations: int = 2, samples: int = 4) -> DataFrame:
    """account_id, embedding of the log co-occurrence matrix of walks up to ``window`` steps, by randomised subspace iteration.

    The matrix is estimated from ``samples`` walks a link (``walk_weights``), so its rows grow with the links, not with the square of
    the accounts. It is stored once, dealt by row: in its product with a block of ``dim`` vectors it stays where it is (``beside``) and its rows
    are summed in their task. Only dim x dim Gram matrices are summed on the driver. The sign of each dimension is that of its largest component.
    """
    import numpy as np

    ids = accounts.select("account_id").distinct()
    held = ids.count()
    pairs = undirected(edges)
    for c in ("u", "v"):
        pairs = pairs.join(beside(ids.withColumnRenamed("account_id", c), held), c, "left_semi")
    nodes, m, n, vol = walk_rows(neighbours(cut(pairs)), window, samples)
    zero = F.array_repeat(F.lit(0.0), dim)
    if not vol:
        return accounts.select("account_id", zero.alias("embedding"))
    m = cut(m)
    y = nodes.select(F.col("i").alias("k"), F.array(*[F.sin(F.xxhash64("k", F.lit(j)) / 1e15) for j in range(dim)]).alias("y"))

    def times(y: DataFrame) -> DataFrame:
        return cut(m.join(beside(y.select(F.col("k").alias("j"), "y"), n), "j").groupBy(F.col("i").alias("k")).agg(F.array(*[F.sum(F.col("v") * F.col("y")[j]) for j in range(dim)]).alias("y")))

    y = times(y)
    w, u = np.linalg.eigh(gram(y, dim))
    scale = None
    for _ in range(iterations + 1):
        w, u = w[::-1], u[:, ::-1]
        q = turned(y, u * np.where(w > 1e-12 * max(w[0], 1e-300), 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0))
        y = times(q)
        w, u = np.linalg.eigh(gram(y, dim))
        scale = np.sqrt(np.sqrt(np.maximum(w[::-1], 0.0)))
    w, u = w[::-1], u[:, ::-1]
    z = turned(y, u * np.where(w > 1e-12 * max(w[0], 1e-300), scale / np.sqrt(np.maximum(w, 1e-300)), 0.0))
    z = cut(z)
    side = z.agg(*[F.max_by(F.signum(F.col("y")[j]), F.struct(F.abs(F.col("y")[j]), "k")) for j in range(dim)]).first()
    out = z.join(nodes.select(F.col("i").alias("k"), F.col("k").alias("account_id")), "k").select("account_id", F.array(*[F.col("y")[j] * float(side[j] or 1.0) for j in range(dim)]).alias("e"))
    return accounts.select("account_id").join(out, "account_id", "left").select("account_id", F.coalesce("e", zero).alias("embedding"))


def wide(df: DataFrame, prefix: str, dim: int = 16) -> DataFrame:
    """The embedding as columns, for export."""
    return df.select("account_id", *[F.col("embedding")[i].alias(f"emb_{prefix}_{i}") for i in range(dim)])
