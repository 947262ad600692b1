"""Orders, forests, walks and point queries against brute force, and what their plans hold."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import embed, forest, graph, learn, order, risk
from ledgerlens.plans.point import LedgerIndex

EDGE = "tx_id long, src string, dst string, amount double, us long, cb int"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("scores", [[float(i) for i in range(500)], [0.0] * 200 + [float(i % 7) for i in range(200)] + [None, None], []])
def test_ranks_and_percentiles(spark, scores):
    rows = [(f"a{i * 7919 % 1000:04d}", s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "account_id string, risk_score double")
    out = risk.rank_scores(df)
    assert "SinglePartition" not in plan(out)
    got = {r.account_id: r for r in out.collect()}
    assert len(got) == len(rows)
    known = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    for n, (a, s) in enumerate(known):
        below = sum((t is None and s is not None) or (t is not None and s is not None and t < s) for _, t in rows)
        same = sum(t == s for _, t in rows)
        assert got[a]["rank"] == n + 1 and got[a].risk_percentile == pytest.approx((below + (same + 1) / 2) / len(rows) * 100)


def test_precision_curve(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([0.1, 0.2, 0.5, 0.50001, 0.9]) if i % 2 else i / 300, int(rnd.random() < 0.3)) for i in range(300)]
    out = learn.pr_metrics(spark.createDataFrame(rows, "score double, label int"))
    assert "SinglePartition, ENSURE" not in plan(out).split("Window")[0] or "Window" not in plan(out)
    got = out.first()
    tp = k = 0
    ap, best, at = 0.0, -1.0, None
    positive = sum(y for _, y in rows)
    for s in sorted({s for s, _ in rows}, reverse=True):
        p, n = sum(y for t, y in rows if t == s), sum(t == s for t, _ in rows)
        tp, k = tp + p, k + n
        ap += p / positive * tp / k
        f1 = 2 * tp / (k + positive)
        if f1 > best + 1e-12 or (abs(f1 - best) <= 1e-12 and s < at):
            best, at = f1, s
    assert got.average_precision == pytest.approx(ap) and got.best_f1 == pytest.approx(best) and got.best_threshold == pytest.approx(at) and got.base_rate == pytest.approx(positive / 300)


def test_quantiles(spark):
    x = [float(i * i % 97) for i in range(1001)] + [3.0] * 400
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    assert order.quantiles(df, "x", [0.0, 0.1, 0.333, 0.98, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.1, 0.333, 0.98, 1.0]).tolist())
    assert order.quantiles(df.where("x > 1000"), "x", [0.5]) is None


def roots(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("most, part", [(500_000, 2_000_000), (500_000, 40), (3, 2_000_000), (0, 10)])
def test_spanning_forest(spark, most, part):
    rnd = random.Random(most + part)
    n = 60
    links = {tuple(sorted(rnd.sample(range(n), 2))): float(rnd.randint(1, 9)) for _ in range(150)}
    links |= {(i, i + 1): 5.0 for i in range(40, 55)}
    rows = [(f"{a:02d}", f"{b:02d}", w) for (a, b), w in links.items()]
    got = forest.spanning_forest(spark.createDataFrame(rows, "u string, v string, w double").repartition(3), most_nodes=most, part_links=part).collect()
    whole = roots(n, links)
    assert len(got) == n - len(set(whole)) and {(r.u, r.v, r.w) for r in got} <= set(rows)
    for t in range(1, 10):
        assert roots(n, [(int(r.u), int(r.v)) for r in got if r.w >= t]) == roots(n, [p for p, w in links.items() if w >= t])


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]
    hub = [("h", f"x{i}") for i in range(50)]
    got = {r.k: r.root for r in forest.connected_components(spark.createDataFrame(chain + hub, "u string, v string").repartition(4)).collect()}
    assert all(got[f"c{i:03d}"] == "c000" for i in range(201)) and got["h"] == "h" and all(got[f"x{i}"] == "h" for i in range(50))


def test_persistence(spark):
    rnd = random.Random(9)
    names = [f"n{i:02d}" for i in range(25)]
    edges = [(i, *rnd.sample(names[:22], 2), float(rnd.randint(1, 60)), i, 0) for i in range(70)] + [(99, "n01", "n01", 50.0, 1, 0), (98, "n01", "elsewhere", 50.0, 1, 0)]
    e, a = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in names], "account_id string")
    got = {r.account_id: (r.betti_birth, r.betti_death, r.betti_persistence) for r in graph.betti_persistence(e, a).collect()}
    inside = [x for x in edges if x[1] in names and x[2] in names]
    lo, hi = np.quantile([x[3] for x in inside], [0.1, 0.98])
    life, of = {}, {x: [] for x in names}
    for i in range(10):
        t = lo + (hi - lo) * i / 9
        r = roots(25, [(names.index(x[1]), names.index(x[2])) for x in inside if x[3] >= t])
        for j, x in enumerate(names):
            key = (r[j], r.count(r[j]))
            life.setdefault(key, set()).add(t)
            of[x].append(key)
    for x in names:
        p, b, d = max((max(life[k]) - min(life[k]), -min(life[k]), max(life[k])) for k in of[x])
        assert got[x] == pytest.approx((-b, d, p)), x


def test_walks_estimate_the_dense_matrix(spark):
    """2000 walks a link: entries within 0.1 of the dense formula where that is above 0.3, the root mean square error under 0.04."""
    rnd = random.Random(3)
    n = 24
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(40)} | {(0, i) for i in range(1, 12)}
    links = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for p in pairs for a, b in (p, p[::-1])], "k string, o string")
    rows, vol = embed.walk_weights(links, samples=2000)
    got = np.zeros((n, n))
    for r in rows.collect():
        got[int(r.k), int(r.o)] = got[int(r.o), int(r.k)] = r.v
    adj = np.zeros((n, n))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    d = adj.sum(1)
    p = adj / np.maximum(d, 1)[:, None]
    dense = np.log(np.maximum(1, vol / 3 * (p + p @ p + p @ p @ p) / np.maximum(d, 1)[None, :]))
    dense[d == 0] = 0
    assert vol == adj.sum() and np.sqrt(((got - dense) ** 2).mean()) < 0.04 and np.abs(got - dense)[dense > 0.3].max() < 0.1
    few, _ = embed.walk_weights(links, samples=2)
    assert few.count() <= links.count() * 5  # rows follow the links: one and two walks of two lengths each


def test_netmf_embeds_its_matrix(spark):
    """The Gram matrix of the embedding is the best approximation of its rank."""
    rnd = random.Random(1)
    names = [f"{i:02d}" for i in range(20)]
    edges = [(i, *(names[x] for x in rnd.sample(range(10) if i % 2 else range(10, 20), 2)), 1.0, i, 0) for i in range(120)] + [(500, "00", "10", 1.0, 1, 0)]
    e, a = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in [*names, "alone"]], "account_id string")
    got = {r.account_id: np.array(r.embedding) for r in embed.netmf(e, a, dim=20, iterations=3, samples=50).collect()}
    assert (got["alone"] == 0).all() and len(got) == 21
    again = {r.account_id: np.array(r.embedding) for r in embed.netmf(e, a, dim=20, iterations=3, samples=50).collect()}
    assert all(np.allclose(got[k], again[k], atol=1e-6) for k in got)
    z = np.stack([got[x] for x in names])
    links = graph.cut(embed.neighbours(embed.undirected(e)))
    m = np.zeros((20, 20))
    for r in embed.walk_weights(links, samples=50)[0].collect():
        m[int(r.k), int(r.o)] = m[int(r.o), int(r.k)] = r.v
    w, u = np.linalg.eigh(m)
    assert np.abs(z @ z.T - u @ np.diag(np.abs(w)) @ u.T).max() < 1e-4
    none = embed.netmf(e.limit(0), a).collect()
    assert len(none) == 21 and all(r.embedding == [0.0] * 16 for r in none)


@pytest.fixture(scope="module")
def indexed(spark):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans prune buckets without saying so
    rnd = random.Random(6)
    edges = [(i, "hub" if i % 3 == 0 else f"a{rnd.randint(0, 30)}", f"a{rnd.randint(0, 30)}", float(rnd.randint(1, 500)), rnd.randint(0, 10**9), i % 2) for i in range(600)]
    edges += [(601, "a1", "a1", 5.0, 5, 0), (602, None, "a1", 1.0, None, 0)]
    yield edges, spark.createDataFrame(edges, EDGE), LedgerIndex.build(spark.createDataFrame(edges, EDGE), buckets=8)
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_point_queries_read_one_bucket(spark, indexed):
    edges, e, index = indexed
    for df in (index.of("a1"), index.transactions("a1")):
        assert "SelectedBucketsCount: 1 out of 8" in plan(df)
    few = spark.createDataFrame([("a1",), ("a2",)], "k string")
    assert "out of 8" in plan(index.near(few)) and "SelectedBucketsCount: 8 out of 8" not in plan(index.near(few))
    mine = sorted(((x[4] is not None, x[4] or 0, x[0]) for x in edges if "a1" in x[1:3]))
    assert [r.tx_id for r in index.transactions("a1").collect()] == [x[2] for x in mine]
    assert index.transactions("nobody").count() == 0 and index.path("nobody").count() == 0
    assert sum(r.amount for r in index.of("hub").collect()) == sum(x[3] for x in edges if x[1] == "hub")


def test_point_queries_equal_scans(spark, indexed):
    edges, e, index = indexed
    a = spark.createDataFrame([("a1", "Ann", "BANK1"), ("a2", None, None)], "account_id string, name string, institution string")
    nodes, links = index.subgraph("a1", a, limit=50)
    want = graph.two_hop_subgraph(e, "a1", limit=50).collect()
    got = links.collect()
    assert Counter((r.source, r.target, r.us, r.amount) for r in got) == Counter((r.src, r.dst, r.us, r.amount) for r in want)
    assert {r.id: r.role for r in nodes.collect()}["a1"] == "target" and {(r.name, r.bank) for r in nodes.where("id = 'a1'").collect()} == {("Ann", "BANK1")}
    near = lambda df: Counter(map(tuple, df.select("tx_id", "src", "dst").collect()))
    assert near(index.within("a5")) == near(graph.ego_subgraph(e, "a5"))
    t = sorted((x for x in edges if "a3" in x[1:3]), key=lambda x: (x[4], x[0]))[:100]
    one = max((x for x in t if x[1] == "a3"), key=lambda x: (x[3], -x[4], -x[0]))
    two = [x for x in t if x[1] == one[2]]
    path = [(r.hop, r.account_id, r.amount) for r in sorted(index.path("a3").collect())]
    assert path[:2] == [(0, "a3", int(t[0][3])), (1, one[2], int(one[3]))] and len(path) == (3 if two else 2)


def test_many_accounts_and_another_session(spark, indexed, monkeypatch, tmp_path):
    edges, e, index = indexed
    monkeypatch.setattr(LedgerIndex, "NAMED", 1)
    few = spark.createDataFrame([("a1",), ("a2",), ("a2",), (None,)], "k string")
    assert index.near(few).count() == sum((x[1] == a) + (x[2] == a) for x in edges for a in ("a1", "a2"))
    LedgerIndex.build(e, buckets=4, location=str(tmp_path / "kept"))
    again = LedgerIndex.open(spark, str(tmp_path / "kept"), buckets=4)
    assert "SelectedBucketsCount: 1 out of 4" in plan(again.of("a2")) and again.of("a2").count() == index.of("a2").count()


def test_levels_of_a_forest_by_one_task_and_by_joins(spark):
    rnd = random.Random(8)
    rows = [(f"{i:02d}", f"{rnd.randint(0, i - 1):02d}", rnd.randint(-1, 3)) for i in range(1, 40)]
    tree = spark.createDataFrame(rows, "u string, v string, level int").repartition(3)
    one = sorted(map(tuple, forest.level_components(tree, 4).select("t_idx", "k", "root").collect()))
    assert one == sorted(map(tuple, forest.level_components(tree, 4, most_links=0).select("t_idx", "k", "root").collect()))
    for t in range(4):
        links = [(int(u), int(v)) for u, v, w in rows if w >= t]
        want = roots(40, links)
        assert [(int(k), int(r)) for i, k, r in one if i == t] == sorted((x, want[x]) for x in {x for p in links for x in p})


def slowest_share(df) -> float:
    """The rows of the largest partition over those of an even deal."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) * len(n) / sum(n)


@pytest.mark.parametrize("ahead, size", [(3, 5), (100, 2000), (7, 7)])
def test_fans_of_a_hub_in_slices(spark, ahead, size):
    rnd = random.Random(ahead)
    edges = [(i, "hub" if i % 4 else f"a{rnd.randint(0, 5)}", f"a{rnd.randint(0, 9)}", 1.0, rnd.randint(0, 3 * 24) * 3_600_000_000, 0) for i in range(150)] + [(999, "hub", "a1", 1.0, None, 0)]
    got = {r.account_id: (r.motif_fanout, r.motif_fanin) for r in graph.motif_fans(spark.createDataFrame(edges, EDGE), ahead=ahead, slice_edges=size).collect()}
    want = Counter()
    for hub, other, way in ((1, 2, 0), (2, 1, 1)):
        for h in {e[hub] for e in edges}:
            mine = sorted((e for e in edges if e[hub] == h and e[4] is not None), key=lambda e: (e[4], e[0]))
            for i, x in enumerate(mine):
                for y in mine[i + 1 : i + 1 + ahead]:
                    if y[4] - x[4] <= 24 * 3_600_000_000 and y[other] != x[other]:
                        for k in (h, x[other], y[other]):
                            want[k, way] += 1
    assert got == {k: (want[k, 0], want[k, 1]) for k in {k for k, _ in want}}


def test_a_hub_of_many_edges_is_dealt_over_tasks(spark):
    hub = spark.range(100_000).select(F.col("id").alias("tx_id"), F.lit("hub").alias("src"), (F.col("id") % 977).cast("string").alias("dst"), F.lit(1.0).alias("amount"), (F.col("id") * 60_000_000).alias("us"), F.lit(0).alias("cb"))
    placed, total = order.sums_before(hub.select("src", "us", "tx_id"), [F.col("src"), F.col("us"), F.col("tx_id")], {"n": F.lit(1)})
    assert total["n"] == 100_000 and slowest_share(placed) < 1.6
    got = graph.motif_fans(hub, ahead=5, slice_edges=500)
    assert got.where("account_id = 'hub'").first().motif_fanout == sum(min(5, 99_999 - i) for i in range(100_000))


def test_band_join_of_round_amounts(spark):
    """One amount in one hour: a grid of cells, each pair once, no task with more than its share."""
    from ledgerlens.operators import typology

    rnd = random.Random(5)
    rows = [(i, "x", "y", rnd.choice([100.0] * 6 + [99.0, 104.9, 60.0, 1e6]), rnd.randint(0, 7_200) * 1_000_000, i % 2) for i in range(400)]
    e = spark.createDataFrame(rows, EDGE)
    for cell in (2000, 17):
        got = Counter((r.a, r.b) for r in typology.band_join(e.where("cb = 1"), e.where("cb = 0"), tolerance=0.05, seconds=3600, cell=cell).select("a.tx_id", "b.tx_id").toDF("a", "b").collect())
        want = Counter((x[0], y[0]) for x in rows for y in rows if x[5] and not y[5] and x[3] * 0.95 <= y[3] <= x[3] * 1.05 and abs(x[4] - y[4]) <= 3_600_000_000)
        assert got == want
    many = spark.range(40_000).select(F.col("id").alias("tx_id"), F.lit("s").alias("src"), F.lit("d").alias("dst"), F.lit(500.0).alias("amount"), (F.col("id") * 20).alias("us"), (F.col("id") % 2).cast("int").alias("cb"))
    pairs = typology.band_join(many.where("cb = 1").limit(9000), many.where("cb = 0").limit(2500), tolerance=0.05, seconds=3600, cell=500)
    assert "CartesianProduct" not in plan(pairs) and pairs.count() == 9000 * 2500


def test_carousels_grow_only_where_a_cycle_can_close(spark):
    """A hub that thousands pay and that pays thousands opens no paths unless some close."""
    from ledgerlens.operators import typology

    hour = 3_600_000_000
    fan = [(i, f"p{i}", "hub", 100.0, i, 0) for i in range(400)] + [(1000 + i, "hub", f"q{i}", 100.0, hour + i, 0) for i in range(400)]
    ring = [(5000, "hub", "r1", 100.0, 2 * hour, 0), (5001, "r1", "r2", 99.5, 3 * hour, 0), (5002, "r2", "hub", 99.2, 4 * hour, 0)]
    e = spark.createDataFrame(fan + ring, EDGE)
    last = e.select("src", "dst", "amount", "us", F.expr(f"us div {24 * hour}").alias("tb"))
    assert typology.in_cycles(last, 24 * hour).count() == 3
    assert {r.account_id: r.details for r in typology.carousel(e).collect()} == dict.fromkeys(["hub", "r1", "r2"], "hub -> r1 -> r2")


def test_refined_parts_are_connected_and_within_communities(spark):
    """On random weighted links: parts split communities, each is connected, and aggregated moves never lower modularity."""
    rnd = random.Random(11)
    n = 50
    links = {tuple(sorted(rnd.sample(range(n), 2))): float(rnd.randint(1, 3)) for _ in range(130)}
    rows = [(f"{x:02d}", f"{y:02d}", w) for (a, b), w in links.items() for x, y in ((a, b), (b, a))] + [("03", "03", 4.0)]
    e = spark.createDataFrame(rows, "k string, o string, w double")
    names = sorted({r[0] for r in rows})
    given = spark.createDataFrame([(x, "A" if int(x) % 3 else "B") for x in names], "k string, c string")
    of = {r.k: r.root for r in graph.refined(e, given, 10).collect()}
    side = {x: bool(int(x) % 3) for x in names}
    assert sorted(of) == names and all(side[x] == side[r] for x, r in of.items()) and 2 < len(set(of.values())) < n
    inside = [(int(a), int(b)) for a, b, _ in rows if of[a] == of[b]]
    comp = roots(n, inside)
    assert len({(of[x], comp[int(x)]) for x in names}) == len(set(of.values()))
    total = sum(w for *_, w in rows)
    deg = {x: sum(w for a, _, w in rows if a == x) for x in names}
    q = lambda c: sum(w for a, b, w in rows if c[a] == c[b]) / total - sum(sum(deg[x] for x in names if c[x] == s) ** 2 for s in set(c.values())) / total**2
    single = spark.createDataFrame([(x, x) for x in names], "k string, c string")
    assert graph.modularity(e, single) == pytest.approx(q({x: x for x in names}))
    moved = {r.k: r.c for r in graph.frontier_moves(e, single, 12).collect()}
    assert q(moved) > 0.25 and graph.modularity(e, graph.frontier_moves(e, given, 12)) >= q({x: side[x] for x in names})


def test_refined_leiden_finds_planted_communities(spark):
    rnd = random.Random(3)
    pairs = [(i, j) for i in range(45) for j in range(i) if rnd.random() < (0.5 if i % 3 == j % 3 else 0.02)]
    e = spark.createDataFrame([(n, f"{i:02d}", f"{j:02d}", 1.0, 0, 0) for n, (i, j) in enumerate(pairs)], EDGE)
    a = spark.createDataFrame([(f"{i:02d}",) for i in range(45)] + [("alone",)], "account_id string")
    c = {r.account_id: r.community_id for r in graph.leiden_refined(e, a).collect()}
    assert c["alone"] == "alone" and len({(int(x) % 3, y) for x, y in c.items() if x != "alone"}) == len({y for x, y in c.items() if x != "alone"}) == 3


def test_triangles_of_pairs_in_either_order_without_two_step_rows(spark):
    rnd = random.Random(9)
    pairs = [tuple(rnd.sample(range(30), 2)) for _ in range(120)] + [(0, i) for i in range(1, 30)]
    links = {frozenset(p) for p in pairs}
    want = sorted([x, y, z] for x in range(30) for y in range(x) for z in range(y) if {frozenset((x, y)), frozenset((y, z)), frozenset((x, z))} <= links)
    df = spark.createDataFrame([(f"{a}", f"{b}") for a, b in [*pairs, *(p[::-1] for p in pairs), (5, 5)]], "u string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = graph.triangles(df)
        at = plan(t)
        assert sorted(sorted(map(int, r), reverse=True) for r in t.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(y#\d+, z#\d+", at) and re.search(r"hashpartitioning\(y#\d+,", at)


def test_ranks_and_risk_go_to_the_links(spark, monkeypatch):
    """Where accounts are few, links aren't dealt again in each step; where they are many, results are the same."""
    rnd = random.Random(5)
    e = spark.createDataFrame([(i, f"a{rnd.randint(0, 9)}", f"a{rnd.randint(0, 14)}", float(1 + i % 7), i * 3_600_000_000, 0) for i in range(120)], EDGE)
    scores = spark.createDataFrame([(f"a{i}", i / 20) for i in range(15)], "account_id string, belief double")
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (True, False):
            if not few:
                monkeypatch.setattr(graph, "beside", lambda values, n: values)
                monkeypatch.setattr(risk, "beside", lambda values, n: values)
            spread = risk.contagion(scores, e)
            assert bool(re.search(r"hashpartitioning\(src#", plan(spread))) == (not few)
            found.append(({r.account_id: r.pagerank for r in graph.pagerank(e).collect()}, {r.account_id: r.risk for r in spread.collect()}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(found[0][0].values()) == pytest.approx(1.0) and len(found[0][1]) == 15
    for a, b in zip(*found):
        assert a == pytest.approx(b)
