"""Centrality, structure and motif operators on the transaction graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.flow import collapse, multigraph, neighbours, undirected
from ledgerlens.operators.forest import connected_components, cut, level_components, spanning_forest
from ledgerlens.operators.order import quantiles, sums_before

HOUR = 3_600_000_000


def beside(values: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """One small row an account, to be joined with links: broadcast for up to ``most`` accounts, so that links stay where they are."""
    return F.broadcast(values) if n <= most else values


def apart(accounts: DataFrame, most: int = 50_000) -> DataFrame:
    """A stored table of a row or less an account that no join broadcasts if it has over ``most`` rows.

    Spark goes by the bytes of a table's files, and of one column of them for a join that needs one, where a row in the driver's memory takes ten times as many.
    """
    return accounts.hint("merge") if accounts.count() > most else accounts


def pagerank(edges: DataFrame, iterations: int = 10, alpha: float = 0.85) -> DataFrame:
    """account_id, pagerank: damped power iteration on summed amounts; rank of nodes without outflow is spread evenly.

    One step is a join on the sender and a sum by receiver, and is stored, so that plans don't grow with the steps. Accounts are numbers in it, since
    the values that a step broadcasts pass through the driver.
    """
    e = cut(collapse(edges))
    placed, total = sums_before(e.select(F.explode(F.array("src", "dst")).alias("k")).where("k is not null").distinct(), [F.col("k")], {"n": F.lit(1)})
    names, n = cut(placed.select("k", "n")), max(total["n"], 1)
    end = lambda c: names.select(F.col("k").alias(c), F.col("n").alias(f"n{c}")).hint("merge")
    e = cut(e.join(end("src"), "src").join(end("dst"), "dst", "left").select(F.col("nsrc").alias("src"), F.col("ndst").alias("dst"), "w"))
    nodes = names.select(F.col("n").alias("k"))
    p = cut(e.join(beside(e.groupBy("src").agg(F.sum("w").alias("tw")), n), "src").select("src", "dst", (F.col("w") / F.col("tw")).alias("p")))
    idle = cut(nodes.join(p.select(F.col("src").alias("k")), "k", "left_anti"))
    x = nodes.withColumn("x", F.lit(1.0 / n))
    for _ in range(iterations):
        x = cut(x)
        flow = cut(p.join(beside(x.withColumnRenamed("k", "src"), n), "src").groupBy(F.col("dst").alias("k")).agg(F.sum(F.col("x") * F.col("p")).alias("f")))
        lost = x.join(idle, "k", "left_semi").select("x").unionByName(flow.where("k is null").select(F.col("f").alias("x"))).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("d"))
        x = nodes.join(flow, "k", "left").join(F.broadcast(lost)).select("k", (alpha * (F.coalesce("f", F.lit(0.0)) + F.col("d") / n) + (1 - alpha) / n).alias("x"))
    return names.hint("merge").join(cut(x).withColumnRenamed("k", "n"), "n").select(F.col("k").alias("account_id"), F.col("x").alias("pagerank"))


def degrees(edges: DataFrame) -> DataFrame:
    from ledgerlens.operators.flow import flow_features

    return flow_features(edges).select("account_id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def triangles(pairs: DataFrame) -> DataFrame:
    """x, y, z of every triangle of undirected pairs (u, v), once each.

    Accounts are numbered in the order of their neighbours' number, and each keeps the list of its neighbours of greater number, so a hub's list is
    short. An account sends each of its list what comes after it there, and what the two lists share closes a triangle: a two-step path is one
    number in an array, not a row.
    """
    pairs = pairs.select("u", "v").where("u <> v")
    nodes, total = sums_before(neighbours(pairs).groupBy("k").agg(F.count("*").alias("d")), [F.col("d"), F.col("k")], {"n": F.lit(1)})
    number = cut(nodes.select("k", F.col("n").cast("int" if total["n"] < 1 << 31 else "long").alias("n")))
    end = lambda c: number.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"))
    ranked = pairs.join(end("u"), "u").join(end("v"), "v").select(F.least("nu", "nv").alias("x"), F.greatest("nu", "nv").alias("y"))
    later = cut(ranked.groupBy("x").agg(F.sort_array(F.collect_set("y")).alias("near")))
    sent = later.select("x", "near", F.posexplode("near").alias("i", "y")).where("i + 1 < size(near)").select("x", "y", F.expr("slice(near, i + 2, size(near))").alias("rest"))
    own = later.select(F.col("x").alias("y"), F.col("near").alias("own")).hint("shuffle_hash")
    closed = sent.join(own, "y").select("x", "y", F.explode(F.array_intersect("rest", "own")).alias("z"))
    for c in ("x", "y", "z"):
        closed = closed.join(number.select(F.col("n").alias(c), F.col("k").alias(f"k{c}")), c)
    return closed.select("kx", "ky", "kz").toDF("x", "y", "z")


def burt_constraint(edges: DataFrame, accounts: DataFrame | None = None, sink_policy: str = "one") -> DataFrame:
    """account_id, structural_constraint; accounts that send nothing are 1 under ``sink_policy`` 'one', as are isolated ones always. Self-loops don't count."""
    e = edges.where("src <> dst").select("src", "dst")
    ways = [F.max((F.col("src") == F.col(c)).cast("long")) for c in ("u", "v")]
    pairs = cut(e.select("src", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).groupBy("u", "v").agg((ways[0] + ways[1]).alias("m")))
    m = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "m"))
    d = m.groupBy("u").agg(F.sum("m").alias("d"))
    p = cut(m.join(d, "u").select("u", "v", (F.col("m") / F.col("d")).alias("p")))
    # only ties over a third account that is a neighbour of both count: triangles, each found once
    t = triangles(pairs)
    six = t.select(F.explode(F.expr("array(struct(x as u, y as m, z as v), struct(x as u, z as m, y as v), struct(y as u, x as m, z as v), struct(y as u, z as m, x as v), struct(z as u, x as m, y as v), struct(z as u, y as m, x as v))")).alias("t")).select("t.*")
    two = six.join(p.select("u", F.col("v").alias("m"), F.col("p").alias("p1")), ["u", "m"]).join(p.select(F.col("u").alias("m"), "v", F.col("p").alias("p2")), ["m", "v"])
    two = two.groupBy("u", "v").agg(F.sum(F.col("p1") * F.col("p2")).alias("q"))
    c = p.join(two, ["u", "v"], "left").groupBy("u").agg(F.sum(F.pow(F.col("p") + F.coalesce("q", F.lit(0.0)), F.lit(2.0))).alias("c"))
    sends = e.select(F.col("src").alias("u"), F.lit(True).alias("s")).distinct()
    out = c.join(sends, "u", "left").select(F.col("u").alias("account_id"), (F.when(F.col("s").isNull(), 1.0).otherwise(F.col("c")) if sink_policy == "one" else F.col("c")).alias("structural_constraint"))
    if accounts is not None:
        out = accounts.select("account_id").join(out, "account_id", "left").na.fill(1.0)
    return out


def scan(edges: DataFrame, accounts: DataFrame, epsilon: float = 0.6, mu: int = 3) -> DataFrame:
    """account_id, scan_cluster: least core id of the cluster (the greatest for borders of several), HUB or OUTLIER otherwise.

    Similarity of adjacent accounts over closed neighbourhoods; a core has ``mu`` similar ones, itself among them.
    """
    ids = accounts.select(F.col("account_id").alias("k")).distinct()
    und = undirected(edges).join(ids.withColumnRenamed("k", "u"), "u", "left_semi").join(ids.withColumnRenamed("k", "v"), "v", "left_semi")
    und = cut(und)
    nb = neighbours(und)
    deg = nb.groupBy("k").agg(F.count("*").alias("d"))
    # common neighbours of adjacent pairs: each triangle is one for each of its sides
    side = triangles(und).select(F.explode(F.expr("array(array(x, y), array(x, z), array(y, z))")).alias("s"))
    common = side.select(F.array_min("s").alias("u"), F.array_max("s").alias("v")).groupBy("u", "v").agg(F.count("*").alias("c"))
    sim = und.join(common, ["u", "v"], "left").join(deg.select(F.col("k").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("k").alias("v"), F.col("d").alias("dv")), "v")
    sim = sim.withColumn("s", (F.coalesce("c", F.lit(0)) + 2) / F.sqrt((F.col("du") + 1) * (F.col("dv") + 1) + 1e-9))
    eps = cut(neighbours(sim.where(f"s >= {epsilon}").select("u", "v")))
    cores = cut(eps.groupBy("k").agg(F.count("*").alias("n")).where(f"n + 1 >= {mu}").select("k"))
    core_edges = eps.join(cores, "k", "left_semi").join(cores.withColumnRenamed("k", "o"), "o", "left_semi").where("k < o").select(F.col("k").alias("u"), F.col("o").alias("v"))
    alone = cores.select(F.col("k").alias("u"), F.col("k").alias("v"))
    comp = connected_components(core_edges.unionByName(alone))
    border = eps.join(cores.withColumnRenamed("k", "o"), "o", "left_semi").join(cores, "k", "left_anti").join(comp.select(F.col("k").alias("o"), "root"), "o").groupBy("k").agg(F.max("root").alias("root"))
    members = cut(comp.unionByName(border))
    seen = nb.join(members, "k", "left_anti").join(members.select(F.col("k").alias("o"), "root"), "o").groupBy("k").agg(F.count_distinct("root").alias("n"))
    out = ids.join(members, "k", "left").join(seen, "k", "left")
    return out.select(F.col("k").alias("account_id"), F.coalesce("root", F.when(F.col("n") >= 2, "HUB").otherwise("OUTLIER")).alias("scan_cluster"))


def betti_persistence(edges: DataFrame, accounts: DataFrame, steps: int = 10) -> DataFrame:
    """account_id, betti_birth, betti_death, betti_persistence of components under rising amount thresholds.

    A component is told by its least member and size: raising the threshold only splits components, so equal
    (least member, size) at two thresholds is the same set. The components at a threshold are those of the greatest
    spanning forest's links that reach it, so only the forest, not the ledger, is looked at for every threshold.
    """
    e = edges.join(accounts.select(F.col("account_id").alias("src")), "src", "left_semi").join(accounts.select(F.col("account_id").alias("dst")), "dst", "left_semi")
    e = cut(e.select("src", "dst", "amount"))
    bounds = quantiles(e, "amount", [0.1, 0.98])
    if bounds is None:
        return accounts.select("account_id", *[F.lit(0.0).alias(c) for c in ("betti_birth", "betti_death", "betti_persistence")])
    lo, hi = bounds
    cuts = F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(lo + (hi - lo) * i / (steps - 1)).alias("t")) for i in range(steps)])
    pairs = e.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("amount").alias("w"))
    tree = spanning_forest(pairs.where(F.col("w") >= lo))
    level = F.size(F.filter(cuts, lambda c: F.col("w") >= c["t"])) - 1
    comp = level_components(tree.select("u", "v", level.alias("level")), steps)
    nodes = accounts.select(F.col("account_id").alias("k"), F.explode(cuts).alias("c")).select("k", "c.t_idx", "c.t")
    every = cut(nodes.join(comp, ["t_idx", "k"], "left").withColumn("root", F.coalesce("root", "k")))
    size = every.groupBy("t_idx", "root").agg(F.count("*").alias("n"), F.first("t").alias("t"))
    span = size.groupBy("root", "n").agg(F.min("t").alias("birth"), F.max("t").alias("death"), F.collect_list("t_idx").alias("at"))
    # a component's members are those of any threshold of its life
    one = span.select("root", "birth", "death", (F.col("death") - F.col("birth")).alias("p"), F.element_at("at", 1).alias("t_idx"))
    mine = every.join(one, ["t_idx", "root"])
    best = mine.groupBy("k").agg(F.max_by(F.struct("birth", "death", "p"), F.struct("p", (-F.col("birth")).alias("b"))).alias("x"))
    return best.select(F.col("k").alias("account_id"), F.col("x.birth").alias("betti_birth"), F.col("x.death").alias("betti_death"), F.col("x.p").alias("betti_persistence"))


def time_bucket(us: str, w: int):
    """The bucket of ``w`` microseconds that a time falls in; whole-number division, so times within ``w`` are at most one bucket apart."""
    return F.expr(f"{us} div {w}")


def ahead_of(us: str, w: int):
    """The buckets that times from ``us`` to ``us + w`` fall in. Joined on these besides the account, a hub's edges meet in pieces."""
    return F.expr(f"array({us} div {w}, {us} div {w} + 1)")


def motif_triangles_cycles(edges: DataFrame, window_hours: float = 24.0) -> DataFrame:
    """account_id, motif_triangle, motif_cycle: closed u>v>w within the window, counted for all three."""
    w = int(window_hours * HOUR)
    e = edges.where("us is not null").select("src", "dst", "us")
    a, b = e.withColumn("tb", F.explode(ahead_of("us", w))).alias("a"), e.withColumn("tb", time_bucket("us", w)).alias("b")
    two = a.join(b, F.expr(f"a.dst = b.src and a.tb = b.tb and b.us > a.us and b.us <= a.us + {w} and a.src <> b.dst")).select(F.expr("a.src as u"), F.expr("a.dst as v"), F.expr("b.dst as w"), F.expr("b.us as t2"), F.expr(f"a.us + {w} as hi"))
    # both closings in one join: the closing edge's ends in either order
    close = e.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), "src", "us")
    two = two.withColumn("p", F.least("u", "w")).withColumn("q", F.greatest("u", "w"))
    hit = two.alias("t").join(close.alias("c"), F.expr("t.p = c.p and t.q = c.q and c.us > t.t2 and c.us <= t.hi"))
    rows = hit.select(F.explode(F.expr("array(t.u, t.v, t.w)")).alias("account_id"), F.expr("int(c.src = t.u)").alias("tri"))
    return rows.groupBy("account_id").agg(F.sum("tri").cast("long").alias("motif_triangle"), F.sum(1 - F.col("tri")).cast("long").alias("motif_cycle"))


def motif_fans(edges: DataFrame, window_hours: float = 24.0, ahead: int = 100, slice_edges: int = 2000) -> DataFrame:
    """account_id, motif_fanout, motif_fanin: pairs of edges of one hub within the window, at most ``ahead`` edges apart, counted for hub and both others.

    Edges are numbered in the order of hub, time and id, and a hub is looked at in slices of ``slice_edges`` numbers; the first
    ``ahead`` edges of a slice are also seen by the slice before it, so pairs over the border count once and a hub of any size is many small
    windows, not one.
    """
    w, size = int(window_hours * HOUR), max(slice_edges, ahead)
    out = []
    for hub, other, name in (("src", "dst", "motif_fanout"), ("dst", "src", "motif_fanin")):
        t = edges.where("us is not null").select(F.col(hub).alias("hub"), F.col(other).alias("o"), "us", "tx_id")
        placed, _ = sums_before(t, [F.col("hub"), F.col("us"), F.col("tx_id")], {"n": F.lit(1)})
        at = F.expr(f"n div {size}")
        seen = F.when((F.col("n") % size < ahead) & (at > 0), F.array(F.struct(at.alias("slice"), F.lit(True).alias("own")), F.struct((at - 1).alias("slice"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("slice"), F.lit(True).alias("own"))))
        cut_up = placed.select("hub", "o", "us", "n", F.explode(seen).alias("s")).select("hub", "o", "us", "n", "s.slice", "s.own")
        frame = Window.partitionBy("hub", "slice").orderBy("n").rowsBetween(1, ahead)
        later = F.when(F.col("own"), F.collect_list(F.struct("o", "us")).over(frame))
        rows = cut_up.select("hub", "o", "us", later.alias("next")).select("hub", "o", F.explode(F.expr(f"filter(next, x -> x.us - us <= {w} and x.o <> o)")).alias("x"))
        each = rows.select(F.explode(F.array("hub", "o", "x.o")).alias("account_id")).groupBy("account_id").agg(F.count("*").alias(name))
        out.append(each)
    return out[0].join(out[1], "account_id", "full").na.fill(0, ["motif_fanout", "motif_fanin"])


def community_cb_ratio(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community_id, comm_cb_ratio: share of cross-border edges by the sender's community; unmapped senders are -1."""
    c = edges.join(communities.select(F.col("account_id").alias("src"), "community_id"), "src", "left")
    return c.groupBy(F.coalesce("community_id", F.lit(-1)).cast("long").alias("community_id")).agg(F.avg("cb").alias("comm_cb_ratio"))


def label_propagation(edges: DataFrame, accounts: DataFrame, rounds: int = 5) -> DataFrame:
    """account_id, community_id: the most frequent label around, ties to the least, starting from own ids; a community is named by its least member."""
    nb = cut(neighbours(undirected(edges)))
    label = accounts.select(F.col("account_id").alias("k"), F.col("account_id").alias("l"))
    for _ in range(rounds):
        votes = nb.join(label.select(F.col("k").alias("o"), "l"), "o").unionByName(label.select(F.col("k").alias("o"), "k", "l")).groupBy("k", "l").agg(F.count("*").alias("n"))
        label = cut(votes.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "l")).alias("b")).select("k", F.col("b.l").alias("l")))
    least = label.groupBy("l").agg(F.min("k").alias("c"))
    return label.join(least, "l").select(F.col("k").alias("account_id"), F.col("c").alias("community_id"))


def modularity(e: DataFrame, label: DataFrame) -> float:
    """Of communities (k, c) on weighted links (k, o, w; both ways, self-loops count twice)."""
    c = e.join(label, "k").join(label.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o")
    by = c.groupBy("c").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("c") == F.col("oc"), F.col("w")).otherwise(0.0)).alias("inside"))
    inside, total, squares = by.agg(F.sum("inside"), F.sum("t"), F.sum(F.col("t") * F.col("t"))).first()
    return inside / total - squares / total**2 if total else 0.0


def turn(k: str, i: int):
    """Whether a node has its turn in round ``i``: each half of the nodes, by hash, every second round."""
    return F.pmod(F.xxhash64(k, F.lit(i // 2)), F.lit(2)) == i % 2


def frontier_moves(e: DataFrame, label: DataFrame, rounds: int) -> DataFrame:
    """k, c: communities after rounds of moves for modularity on weighted links (k, o, w; both ways, self-loops count twice).

    In each round half of the nodes, by hash, may go to the neighbouring community of greatest gain, ties to the least. After
    the first two rounds only nodes with a neighbour that moved in the last two are looked at, and two rounds without a move end the moves. What comes
    out is never of lower modularity than what came in. A round is joins and sums over links, whatever the size of communities and components.
    """
    deg = cut(e.groupBy("k").agg(F.sum("w").alias("d")))
    two_m = deg.agg(F.sum("d")).first()[0]
    links, start = e.where("k <> o"), label
    moved: list[DataFrame] = []
    for i in range(rounds):
        near = links.where(turn("k", i))
        if i >= 2:
            recent = moved[-2].unionByName(moved[-1])
            near = near.join(links.join(recent.withColumnRenamed("k", "o"), "o", "left_semi").select("k").distinct(), "k", "left_semi")
        total = deg.join(label, "k").groupBy("c").agg(F.sum("d").alias("t"))
        to = near.join(label.select(F.col("k").alias("o"), "c"), "o").groupBy("k", "c").agg(F.sum("w").alias("w"))
        own = label.join(deg, "k").select("k", F.col("c").alias("was"), "d")
        here = to.select("k").distinct().join(label, "k").select("k", "c", F.lit(0.0).alias("w"))
        gain = to.unionByName(here).groupBy("k", "c").agg(F.sum("w").alias("w")).join(own, "k").join(total, "c")
        gain = gain.withColumn("g", F.col("w") - F.col("d") * (F.col("t") - F.when(F.col("c") == F.col("was"), F.col("d")).otherwise(0.0)) / two_m)
        best = gain.groupBy("k", "was").agg(F.min(F.struct((-F.round("g", 9)).alias("g"), (F.col("c") != F.col("was")).alias("moves"), "c")).alias("b"))
        go = cut(best.where("b.c <> was").select("k", F.col("b.c").alias("new")))
        moved.append(go.select("k"))
        n = go.count()
        if n:
            label = cut(label.join(go, "k", "left").select("k", F.coalesce("new", "c").alias("c")))
        elif len(moved) > 1 and moved[-2].isEmpty():
            break
    return label if modularity(e, label) > modularity(e, start) + 1e-9 else start


def refined(e: DataFrame, label: DataFrame, rounds: int) -> DataFrame:
    """k, root: parts of each community, grown from single nodes by joining along links what is well connected in the community.

    A set is well connected if its links to the rest of its community are at least what its degrees make likely. In each round the
    nodes of one half, by hash, that are still alone and well connected join the well-connected set of their community of
    greatest gain, if there is one that gains; such nodes join no node that joins in the same round, so parts stay connected. What never joins stays
    alone, for the next level to place.
    """
    deg = cut(e.groupBy("k").agg(F.sum("w").alias("d")).join(label, "k"))
    two_m = deg.agg(F.sum("d")).first()[0]
    whole = deg.groupBy("c").agg(F.sum("d").alias("dc"))
    inside = cut(e.where("k <> o").join(label, "k").join(label.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o").where("c = oc").select("k", "o", "w"))
    part = label.select("k", F.col("k").alias("root"))
    idle = 0
    for i in range(rounds):
        both = inside.join(part, "k").join(part.select(F.col("k").alias("o"), F.col("root").alias("to")), "o").where("root <> to")
        to = cut(both.groupBy("k", "root", "to").agg(F.sum("w").alias("w")))
        out = to.groupBy("root").agg(F.sum("w").alias("out"))
        sets = deg.join(part, "k").groupBy("root", "c").agg(F.sum("d").alias("ds"), F.count("*").alias("n")).join(whole, "c").join(out, "root")
        well = sets.where(F.col("out") >= F.col("ds") * (F.col("dc") - F.col("ds")) / two_m)
        alone = (F.col("n") == 1) & turn("root", i)
        joins = well.where(alone).select("root", F.col("ds").alias("d"))
        open_ = well.where(~alone).select(F.col("root").alias("to"), F.col("ds").alias("dt"))
        gain = to.join(joins, "root").join(open_, "to").withColumn("g", F.round(F.col("w") - F.col("d") * F.col("dt") / two_m, 9)).where("g > 0")
        go = cut(gain.groupBy("k").agg(F.min(F.struct((-F.col("g")).alias("g"), "to")).alias("b")).select("k", F.col("b.to").alias("to")))
        if go.isEmpty():
            idle += 1
            if idle == 2:  # neither half joins
                break
        else:
            idle = 0
            part = cut(part.join(go, "k", "left").select("k", F.coalesce("to", "root").alias("root")))
    return part


def leiden_refined(edges: DataFrame, accounts: DataFrame, rounds: int = 12, levels: int = 8) -> DataFrame:
    """account_id, community_id by moves for modularity, refinement and aggregation, at any size; a community is named by its least account.

    A level moves nodes (``frontier_moves``), grows well-connected parts within each community (``refined``) and makes the parts the nodes
    of the next level, which start in the communities that they came from. Levels end when parts join nothing more; then each community's connected
    parts are the result. Accounts without links are communities of their own. It takes more rounds than ``leiden``, which splits communities into connected
    parts only.
    """
    pairs = cut(undirected(edges))
    alone = accounts.select("account_id")
    if pairs.isEmpty():
        return alone.select("account_id", F.col("account_id").alias("community_id"))
    first = cut(pairs.select(F.col("u").alias("k"), F.col("v").alias("o"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("v").alias("k"), F.col("u").alias("o"), F.lit(1.0).alias("w"))))
    e, place = first, first.select("k").distinct().select("k", F.col("k").alias("node"))  # account to node of the level
    label = e.select("k").distinct().select("k", F.col("k").alias("c"))
    size = label.count()
    for _ in range(levels):
        label = frontier_moves(e, label, rounds)
        part = refined(e, label, rounds)
        n = part.select("root").distinct().count()
        if n == size:
            break
        size = n
        up = part.select("k", "root")
        place = cut(place.join(up.withColumnRenamed("k", "node"), "node").select("k", F.col("root").alias("node")))
        label = cut(label.join(part, "k").groupBy("root").agg(F.min("c").alias("c")).withColumnRenamed("root", "k"))
        far = up.select(F.col("k").alias("o"), F.col("root").alias("ro"))
        e = cut(e.join(up, "k").join(far, "o").groupBy(F.col("root").alias("k"), F.col("ro").alias("o")).agg(F.sum("w").alias("w")))
    found = cut(place.join(label.withColumnRenamed("k", "node"), "node").select("k", "c"))
    inside = first.where("k < o").join(found, "k").join(found.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o").where("c = oc").select(F.col("k").alias("u"), F.col("o").alias("v"))
    comp = connected_components(inside.unionByName(found.select(F.col("k").alias("u"), F.col("k").alias("v"))))
    named = comp.select(F.col("k").alias("account_id"), F.col("root").alias("community_id"))
    return alone.join(named, "account_id", "left").select("account_id", F.coalesce("community_id", "account_id").alias("community_id"))


def local_moves(e: DataFrame, label: DataFrame, rounds: int) -> DataFrame:
    """k, c: communities after rounds of moves for modularity on weighted links (k, o, w; both ways, self-loops count twice).

    In each round half of the nodes, by hash, may go to the neighbouring community of greatest gain, ties to the least,
    and a round that raises modularity no more ends the moves. A round is joins and sums over the links, whatever the
    size of communities and components.
    """
    deg = cut(e.groupBy("k").agg(F.sum("w").alias("d")))
    two_m = deg.agg(F.sum("d")).first()[0]

    def modularity(label: DataFrame) -> float:
        c = e.join(label, "k").join(label.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o")
        inside = c.agg(F.coalesce(F.sum(F.when(F.col("c") == F.col("oc"), F.col("w"))), F.lit(0.0))).first()[0]
        total = deg.join(label, "k").groupBy("c").agg(F.sum("d").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        return inside / two_m - total / two_m**2

    best, idle = modularity(label), 0
    for i in range(rounds):
        total = deg.join(label, "k").groupBy("c").agg(F.sum("d").alias("t"))
        near = e.where("k <> o").join(label.select(F.col("k").alias("o"), "c"), "o").groupBy("k", "c").agg(F.sum("w").alias("w"))
        own = label.join(deg, "k").select("k", F.col("c").alias("was"), "d")
        stay = label.select("k", "c", F.lit(0.0).alias("w"))
        gain = near.unionByName(stay).groupBy("k", "c").agg(F.sum("w").alias("w")).join(own, "k").join(total, "c")
        gain = gain.withColumn("g", F.col("w") - F.col("d") * (F.col("t") - F.when(F.col("c") == F.col("was"), F.col("d")).otherwise(0.0)) / two_m)
        to = gain.groupBy("k", "was").agg(F.min(F.struct((-F.round("g", 9)).alias("g"), (F.col("c") != F.col("was")).alias("moves"), "c")).alias("b"))
        new = cut(to.select("k", F.when(F.pmod(F.xxhash64("k", F.lit(i // 2)), F.lit(2)) == i % 2, F.col("b.c")).otherwise(F.col("was")).alias("c")))
        q = modularity(new)
        if q > best + 1e-9:
            best, label, idle = q, new, 0
        else:
            idle += 1
            if idle == 2:  # neither half gains
                break
    return label


def leiden(edges: DataFrame, accounts: DataFrame, rounds: int = 12, levels: int = 8) -> DataFrame:
    """account_id, community_id by moves for modularity, refinement and aggregation, at any size; a community is named by its least account.

    A level moves nodes (``local_moves``), splits each community into its connected parts and makes the parts the nodes
    of the next level, which start in the communities that they came from. Levels end when moves join nothing more.
    Accounts without links are communities of their own.
    """
    pairs = cut(undirected(edges))
    alone = accounts.select("account_id")
    if pairs.isEmpty():
        return alone.select("account_id", F.col("account_id").alias("community_id"))
    e = cut(pairs.select(F.col("u").alias("k"), F.col("v").alias("o"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("v").alias("k"), F.col("u").alias("o"), F.lit(1.0).alias("w"))))
    place = e.select("k").distinct().select("k", F.col("k").alias("node"))  # account to node of the level
    label, size = e.select("k").distinct().select("k", F.col("k").alias("c")), None
    for _ in range(levels):
        label = local_moves(e, label, rounds)
        inside = e.where("k < o").join(label, "k").join(label.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o").where("c = oc")
        own = label.select(F.col("k").alias("u"), F.col("k").alias("v"))
        part = connected_components(inside.select(F.col("k").alias("u"), F.col("o").alias("v")).unionByName(own))
        place = cut(place.join(part.select(F.col("k").alias("node"), "root"), "node").select("k", F.col("root").alias("node")))
        n = part.select("root").distinct().count()
        if n == size:
            break
        size = n
        label = cut(label.join(part, "k").groupBy("root").agg(F.min("c").alias("c")).withColumnRenamed("root", "k"))
        up = part.select("k", "root")
        e = cut(e.join(up, "k").join(up.select(F.col("k").alias("o"), F.col("root").alias("ro")), "o").groupBy(F.col("root").alias("k"), F.col("ro").alias("o")).agg(F.sum("w").alias("w")))
    found = place.select(F.col("k").alias("account_id"), F.col("node").alias("community_id"))
    return alone.join(found, "account_id", "left").select("account_id", F.coalesce("community_id", "account_id").alias("community_id"))


def two_hop_subgraph(edges: DataFrame, account: str, limit: int = 200) -> DataFrame:
    """source, target, us, amount, role_source, role_target around an account, both directions; a node's role is its least distance."""
    e = edges.select("src", "dst", "us", "amount", "tx_id")
    one = e.where((F.col("src") == account) | (F.col("dst") == account))
    near = one.select(F.explode(F.array("src", "dst")).alias("k")).where(F.col("k") != account).distinct()
    two = e.join(near.withColumnRenamed("k", "src"), "src", "left_semi").unionByName(e.join(near.withColumnRenamed("k", "dst"), "dst", "left_semi"))
    rows = one.unionByName(two).groupBy("src", "dst", "us").agg(F.min("amount").alias("amount"))
    mark = near.withColumn("near", F.lit(True))
    role = lambda c: F.when(F.col(c) == account, "target").when(F.col(f"{c}_near").isNotNull(), "intermediary").otherwise("destination")
    for c in ("src", "dst"):
        rows = rows.join(mark.select(F.col("k").alias(c), F.col("near").alias(f"{c}_near")), c, "left")
    return rows.select("src", "dst", "us", "amount", role("src").alias("role_source"), role("dst").alias("role_target")).orderBy("us", "src", "dst").limit(limit)


def ego_subgraph(edges: DataFrame, account: str, hops: int = 2) -> DataFrame:
    """Edges among all accounts within ``hops`` undirected steps; the frontier grows by semi joins."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(account,)], "k string")
    for _ in range(hops):
        out = edges.join(seen.withColumnRenamed("k", "src"), "src", "left_semi").select(F.col("dst").alias("k"))
        back = edges.join(seen.withColumnRenamed("k", "dst"), "dst", "left_semi").select(F.col("src").alias("k"))
        seen = cut(seen.unionByName(out).unionByName(back).distinct())
    return edges.join(seen.withColumnRenamed("k", "src"), "src", "left_semi").join(seen.withColumnRenamed("k", "dst"), "dst", "left_semi").select("tx_id", "src", "dst", "amount", "us", "cb")


def evidence_subgraph(accounts: DataFrame, edges: DataFrame, account: str, hops: int = 2) -> DataFrame:
    """relation, source, target, amount, us, cb: edges of all relations among what lies within ``hops`` undirected steps of an account."""
    e = multigraph(accounts, edges)[1]
    seen = e.sparkSession.createDataFrame([(account,)], "k string")
    for _ in range(hops):
        out = e.join(seen.withColumnRenamed("k", "source"), "source", "left_semi").select(F.col("target").alias("k"))
        back = e.join(seen.withColumnRenamed("k", "target"), "target", "left_semi").select(F.col("source").alias("k"))
        seen = cut(seen.unionByName(out).unionByName(back).distinct())
    within = e.join(seen.withColumnRenamed("k", "source"), "source", "left_semi").join(seen.withColumnRenamed("k", "target"), "target", "left_semi")
    return within.select("relation", "source", "target", "amount", "us", "cb")


def ego_edges(edges: DataFrame, account: str, limit: int = 80) -> DataFrame:
    """The account's first ``limit`` transactions by time and id, parallel ones apart."""
    return edges.where((F.col("src") == account) | (F.col("dst") == account)).orderBy("us", "tx_id").limit(limit)


def alluvial_path(edges: DataFrame, account: str) -> DataFrame:
    """The account's largest outgoing transaction and its receiver's largest: up to two rows (hop, src, dst, amount); missing hops stay missing."""
    top = lambda df, hop: df.orderBy(F.desc("amount"), "tx_id").limit(1).select(F.lit(hop).alias("hop"), "src", "dst", "amount")
    one = top(edges.where((F.col("src") == account) & (F.col("dst") != account)), 1)
    nxt = edges.join(one.select(F.col("dst").alias("src")), "src", "left_semi").where((F.col("dst") != F.col("src")) & (F.col("dst") != account))
    return one.unionByName(top(nxt, 2))
