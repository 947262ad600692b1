"""Connected components and the greatest spanning forest of undirected links."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.shared import stored


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage ended by a table in the shared checkpoint folder."""
    return stored(df, "graph")


def connected_components(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """k, root of undirected pairs (u, v), apart for every value of ``keys``; the root is the least member.

    Every node has a parent. In a round a node and its parent are both hung under the least grandparent around the node, and
    chains are halved, until no grandparent changes: a few rounds, for long chains too. A round is stored once.
    """
    keys = keys or []
    both = cut(pairs.select(*keys, F.col("u").alias("k"), F.col("v").alias("o")).unionByName(pairs.select(*keys, F.col("v").alias("k"), F.col("u").alias("o"))))
    kind = both.schema["k"].dataType.simpleString()

    def placed(up: DataFrame) -> DataFrame:
        """k, up, gp, was: parents with the parents' parents."""
        above = up.select(*keys, F.col("k").alias("up"), F.col("up").alias("gp"))
        return cut(up.join(above, [*keys, "up"]).select(*keys, "k", "up", "gp", "was"))

    label = placed(both.groupBy(*keys, "k").agg(F.least(F.col("k"), F.min("o")).alias("up")).withColumn("was", F.lit(None).cast(kind)))
    while True:
        far = label.select(*keys, F.col("k").alias("o"), F.col("gp").alias("m"))
        near = both.join(far, [*keys, "o"]).select(*keys, "k", "m", *[F.lit(None).cast(kind).alias(c) for c in ("up", "gp")])
        own = label.select(*keys, "k", F.col("gp").alias("m"), "up", "gp")
        least = near.unionByName(own).groupBy(*keys, "k").agg(F.min("m").alias("m"), F.max("up").alias("up"), F.max("gp").alias("gp"))
        hung = F.explode(F.array(F.struct("k", "m", F.col("gp").alias("was")), F.struct(F.col("up").alias("k"), "m", F.lit(None).cast(kind).alias("was")))).alias("x")
        label = placed(least.select(*keys, hung).select(*keys, "x.*").groupBy(*keys, "k").agg(F.min("m").alias("up"), F.max("was").alias("was")))
        if label.where("gp <> was").isEmpty():
            return label.select(*keys, "k", F.col("gp").alias("root"))


def least_members(a, b, n: int):
    """The least number of the component of each of ``n`` numbers, for links between ``a`` and ``b``."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, ra, rb)
        np.minimum.at(root, rb, ra)
        while (root != root[root]).any():
            root = root[root]
    return root


def level_components(tree: DataFrame, levels: int, *, most_links: int = 2_000_000) -> DataFrame:
    """t_idx, k, root: the components of a forest (u, v, level) by the links of each level or above, for levels 0 to ``levels`` - 1.

    Nodes without a link of the level have no row. A forest of at most ``most_links`` is walked in one task from the highest level down,
    each link once; a larger one by joins for all levels at once. The rows are the same.
    """
    kind = tree.schema["u"].dataType.simpleString()
    if tree.count() > most_links:
        at = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("t_idx")
        return connected_components(tree.where("level >= 0").select("u", "v", at), ["t_idx"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        names = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks()
        code = names.dictionary_encode()
        known = code.dictionary.take(pc.sort_indices(code.dictionary))  # numbers in the order of names
        place = np.empty(len(known), np.int64)
        place[pc.sort_indices(code.dictionary).to_numpy()] = np.arange(len(known))
        number = place[code.indices.to_numpy()]
        a, b, level = number[: len(t)], number[len(t) :], t["level"].to_numpy()
        root, linked = np.arange(len(known)), np.zeros(len(known), bool)
        for i in range(levels - 1, -1, -1):
            new = level == i if i < levels - 1 else level >= i
            linked[a[new]] = linked[b[new]] = True
            root = least_members(root[a[new]], root[b[new]], len(known))[root]
            k = np.flatnonzero(linked)
            yield pa.record_batch({"t_idx": pa.array(np.full(len(k), i), pa.int32()), "k": known.take(pa.array(k)), "root": known.take(pa.array(root[k]))})

    return tree.select("u", "v", "level").coalesce(1).mapInArrow(run, f"t_idx int, k {kind}, root {kind}")


def part_forest(batches: Iterator) -> Iterator:
    """The greatest spanning forest of a task's links (a, b, w, u, v): in each round every tree takes its best link out, all at once."""
    import numpy as np
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    t = t.sort_by([("w", "descending"), ("u", "ascending"), ("v", "ascending")])
    ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks]).dictionary_encode().combine_chunks()
    code = ends.indices.to_numpy()
    a, b = code[: len(t)], code[len(t) :]
    tree = np.arange(len(ends.dictionary))
    left, kept = np.arange(len(t)), []
    while len(left):
        ta, tb = tree[a[left]], tree[b[left]]
        apart = ta != tb
        left, ta, tb = left[apart], ta[apart], tb[apart]
        if not len(left):
            break
        best = np.full(len(tree), len(t))
        np.minimum.at(best, ta, left)
        np.minimum.at(best, tb, left)
        own = np.flatnonzero(best < len(t))
        link = best[own]
        kept.append(np.unique(link))
        to = tree.copy()
        other = tree[a[link]] + tree[b[link]] - own
        to[own] = other
        low = (to[other] == own) & (own < other)  # of two that chose each other the lesser stays
        to[own[low]] = own[low]
        while (to != to[to]).any():
            to = to[to]
        tree = to[tree]
    if kept:
        yield from t.take(np.sort(np.concatenate(kept))).to_batches()


def spanning_forest(pairs: DataFrame, *, most_nodes: int = 500_000, part_links: int = 2_000_000) -> DataFrame:
    """u, v, w: a spanning forest of greatest weights of undirected links (u < v, once each); ties by u, v.

    The components of all links of at least some weight are those of the forest's. While more than ``most_nodes`` trees are left, each
    takes its best link out and trees that are linked become one, in joins and sums. For fewer trees, tasks thin
    out links: what isn't in the forest of some links isn't in that of all, so each task keeps the forest of its part,
    at most as many links as trees, until one part of at most ``part_links`` is left.
    """
    e = cut(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    kind = e.schema["a"].dataType.simpleString()
    done = []
    ends = e.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    while ends.count() > most_nodes:
        side = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("s")
        first = F.min(F.struct((-F.col("w")).alias("w"), "u", "v", "s.o")).alias("x")
        pick = cut(e.select("*", side).groupBy("s.c").agg(first).select("c", "x.o", (-F.col("x.w")).alias("w"), "x.u", "x.v"))
        done.append(pick.select("u", "v", "w").distinct())
        back = pick.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        to = cut(pick.join(back, "o").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("r")))
        while True:
            far = to.select(F.col("c").alias("r"), F.col("r").alias("rr"))
            new = cut(to.join(far, "r").select("c", F.col("rr").alias("r"), F.col("r").alias("was")))
            to = new.select("c", "r")
            if new.where("r <> was").isEmpty():
                break
        moved = e.join(to.select(F.col("c").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("c").alias("b"), F.col("r").alias("rb")), "b").where("ra <> rb")
        near = moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct((-F.col("w")).alias("w"), "u", "v")).alias("x"))
        e = cut(near.select("a", "b", (-F.col("x.w")).alias("w"), "x.u", "x.v"))
        ends = e.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    n = e.count()
    parts = 2 * max(1, -(-n // part_links))
    while n:
        # half as many parts at least in each round: a part holds at most two forests
        parts = max(1, min(parts // 2, -(-n // part_links)))
        dealt = e.repartition(parts, "u", "v") if parts > 1 else e.coalesce(1)
        e = cut(dealt.mapInArrow(part_forest, f"a {kind}, b {kind}, w {e.schema['w'].dataType.simpleString()}, u {kind}, v {kind}"))
        if parts == 1:
            break
        n = e.count()
    done.append(e.select("u", "v", "w"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
