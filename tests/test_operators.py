"""The planted scenarios: small ledgers whose results are known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import indel_ratio, phonetic, risk_band, sentence_case
from ledgerlens.operators import flow, graph, learn, risk, text, typology
from ledgerlens.sources import ledger, sinks

HOUR = 3_600_000_000


def edges(spark, rows):
    return spark.createDataFrame([(i, s, d, float(a), None if h is None else int(h * HOUR), cb) for i, (s, d, a, h, cb) in enumerate(rows)], "tx_id long, src string, dst string, amount double, us long, cb int")


@pytest.fixture(scope="module")
def small(spark):
    return edges(spark, [("101", "102", 950000, 10, 0), ("101", "102", 50000, 10 + 1 / 12, 0), ("102", "103", 1000000, 35, 1), ("103", "104", 2000000, 60, 0)])


def by(df, key="account_id"):
    return {r[key]: r for r in df.collect()}


def test_volumes_and_asymmetry(small):
    f = by(flow.flow_features(small))
    assert f["101"].out_volume == f["102"].in_volume == f["102"].out_volume == 1e6 and f["103"].out_volume == 2e6 and f["104"].out_volume == 0
    assert f["101"].dfa_score == pytest.approx(1) and f["102"].dfa_score == pytest.approx(0, abs=1e-9) and f["103"].dfa_score == pytest.approx(1 / 3)


def test_hawkes(small):
    h = by(flow.hawkes(small))
    assert h["101"].hawkes_intensity == pytest.approx(0.01 + 0.5 * math.exp(-1 / 12)) and h["104"].hawkes_intensity == pytest.approx(0.01)


def test_threshold_band(small):
    t = by(flow.tps(small))
    assert t["101"].tps_score == 0.5 and t["102"].tps_score == 0  # a million is outside


def test_pagerank_sums_to_one(small):
    assert graph.pagerank(small).agg(F.sum("pagerank")).first()[0] == pytest.approx(1)


def test_phonetics_and_ratio(spark):
    d = spark.createDataFrame([("Robert", "Rupert"), ("Ashcraft", "Ashcroft"), ("", "")], "a string, b string").select(phonetic(F.col("a")).alias("x"), phonetic(F.col("b")).alias("y"), indel_ratio("a", "b").alias("r")).collect()
    assert d[0].x == d[0].y == "R163" and d[1].x == d[1].y == "A261" and d[2].x == "" and d[0].r == pytest.approx(2 * 4 / 12)


def test_linking(spark):
    a = ledger.normalise_accounts(spark.createDataFrame([(1, "123", "John Smith"), (2, "456", "Robert Jones")], "account_id int, tax_number string, name string"))
    e = spark.createDataFrame([("R1", "John", "Smith", "123", ""), ("R2", "Rupert", "Jones", "999", ""), ("R3", "Unknown", "Guy", "000", "")], "report_id string, first_name string, last_name string, tax_number string, narrative string")
    got = {(r.report_id, r.account_id, r.match_method) for r in text.link_entities(e, a).collect()}
    assert got == {("R1", "1", "direct"), ("R2", "2", "phonetic_fuzzy")}


def test_claims(spark):
    n = spark.createDataFrame([("R", "Large sums went abroad"), ("S", None)], "report_id string, narrative string")
    assert {r.claim_type for r in text.extract_claims(n).collect()} == {"cross_border_activity", "high_volume"}


def features(spark, rows):
    return spark.createDataFrame(rows, "account_id string, acct_type string, flow_ratio double, in_volume double, out_volume double, hawkes_intensity double, pagerank double, tps_score double, band_recipients long")


def f(a, ratio=0.0, out=0.0, hawkes=0.0, pr=0.0, kind="SAVINGS", tps=0.0, br=0, vin=0.0):
    return (a, kind, ratio, vin, out, hawkes, pr, tps, br)


def flagged(df):
    return {r.account_id for r in df.collect()}


def test_layering(spark):
    e = edges(spark, [("1", "2", 250000, 0, 0), ("2", "3", 250000, 2, 0), ("3", "4", 250000, 4, 0)])
    assert "4" in flagged(typology.layering(e, features(spark, [f("1", 1.0, 250000.0), f("2"), f("3"), f("4")])))


def test_structuring(spark):
    e = edges(spark, [("2", x, 950000, None, 0) for x in ("21", "22", "23")] + [("2", "3", 250000, None, 0)])
    got = typology.structuring(flow.tps(e)).collect()
    assert [r.account_id for r in got] == ["2"] and got[0].confidence == pytest.approx(0.925)


def test_carousel(spark):
    e = edges(spark, [("3", "31", 500000, 0, 0), ("31", "32", 500000, 1, 0), ("32", "3", 500000, 2, 0), ("3", "9", 1, None, 0)])
    assert flagged(typology.carousel(e)) == {"3", "31", "32"}


def test_mule_loan_and_shell(spark):
    fs = features(spark, [f("4", 1.0, 150000.0, 0.9), f("7", 0.98, 1.0, 0.0, 0.006), f("9", 0.98, 8e5, 0.0, 0.0, "CURRENT")])
    assert flagged(typology.mule(fs)) == {"4"}
    assert flagged(typology.loan_back(edges(spark, [("7", "71", 1, 0, 0), ("71", "7", 1, 1, 0)]), fs)) == {"7"}
    c = spark.createDataFrame([("9", 2), ("9_memb", 2)], "account_id string, community_id int")
    assert flagged(typology.shell_layering(edges(spark, [("9_memb", "9", 800000, None, 0)]), fs, c)) == {"9"}


def test_accumulate(spark):
    e = edges(spark, [(f"i{i}", "5", 150000, 0, 0) for i in range(5)] + [("5", f"o{i}", 150000, 5, 0) for i in range(5)])
    assert flagged(typology.accumulate_disperse(e)) == {"5"}


def test_ghost_flow_and_band_edges(spark):
    rows = [("cs", "cr", 350000, 0, 1), ("ds", "6", 350000, 5 / 60, 0)]
    assert flagged(typology.ghost_flow(edges(spark, rows))) == {"cs", "6"}
    assert not flagged(typology.ghost_flow(edges(spark, [*rows, ("6", "cs", 1, 0, 0)])))
    assert flagged(typology.ghost_flow(edges(spark, [("a", "b", 100, 0, 1), ("c", "d", 95, 1, 0)]))) == {"a", "d"}


def test_ghost_payroll(spark):
    e = edges(spark, [("8", f"e{i}", 80000, 0, 0) for i in range(10)] + [(f"e{i}", "801", 80000, 2, 0) for i in range(10)])
    assert flagged(typology.ghost_payroll(e, features(spark, [f(f"e{i}", 1.0) for i in range(10)]))) == {"8", "801"}


def test_motifs_respect_the_window(spark):
    m = by(graph.motif_triangles_cycles(edges(spark, [("u", "v", 1, 0, 0), ("v", "w", 1, 1, 0), ("u", "w", 1, 24, 0), ("w", "u", 1, 25, 0), ("x", "x", 1, None, 0)])))
    # u>v>w closes as a triangle at 24 h; v>w>u is closed by nothing
    assert (m["u"].motif_triangle, m["u"].motif_cycle) == (1, 0)


def test_scan_and_components(spark):
    e = edges(spark, [(a, b, 1, 0, 0) for a, b in ("ab", "bc", "ca", "xy", "yz", "zx", "ch", "hx")])
    ids = spark.createDataFrame([(c,) for c in "abcxyzhq"], "account_id string")
    s = {r.account_id: r.scan_cluster for r in graph.scan(e, ids).collect()}
    assert s["a"] == s["b"] == s["c"] and s["x"] == s["y"] == s["z"] != s["a"] and s["q"] == "OUTLIER"
    root = {r.k: r.root for r in graph.connected_components(spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)], "u string, v string")).collect()}
    assert set(root.values()) == {"0"}


def test_dempster(spark):
    d = spark.sql("select struct(.8D as s, .1D as n, .1D as t) m1, struct(.6D as s, .2D as n, .2D as t) m2").select(F.expr(risk.combine("m1", "m2")).alias("m")).first().m
    assert (d.s, d.n, d.t) == (pytest.approx(0.897436, abs=1e-6), pytest.approx(0.076923, abs=1e-6), pytest.approx(0.025641, abs=1e-6))


def test_bands_are_right_closed(spark):
    got = spark.createDataFrame([(x,) for x in (0.25, 0.5, 0.75, 0.9, 0.91)], "s double").select(risk_band(F.col("s")).alias("b")).collect()
    assert [r.b for r in got] == ["LOW", "ELEVATED", "HIGH", "SEVERE", "CRITICAL"]


def test_ranks_with_ties(spark):
    s = by(risk.rank_scores(spark.createDataFrame([("101", 0.1), ("202", 0.8), ("303", 0.45), ("404", 0.45)], "account_id string, risk_score double")))
    assert [s[a]["rank"] for a in ("202", "303", "404", "101")] == [1, 2, 3, 4] and s["303"].risk_percentile == s["404"].risk_percentile == 62.5


def test_fusion_order(spark):
    fs = features(spark, [f("101"), f("102")])
    sc = spark.createDataFrame([("101", 0.1), ("102", 0.9)], "account_id string, risk_score double")
    al = spark.createDataFrame([("102", "x", 0.85, "")], "account_id string, typology string, confidence double, details string")
    v = spark.createDataFrame([("R", "102", "high_volume", "CONFIRMED")], "report_id string, account_id string, claim_type string, verification_status string")
    got = by(risk.fuse(sc, fs, al, v))
    assert got["102"].belief > got["101"].belief and 0 <= got["101"].belief <= got["101"].plausibility <= 1


def test_driver_shares_and_edges(spark):
    s = spark.createDataFrame([("101", "sent_amount", 4.0), ("101", "received_x", -3.0), ("101", "community_id", 2.0), ("101", "cross_border_flag", 1.0)], "account_id string, feature string, shap_value double")
    assert {r.driver_group: r.share for r in risk.driver_shares(s).collect()} == {"self_behavior": 0.4, "counterparty": 0.3, "community": 0.2, "external": 0.1}
    c = risk.counterfactual_edges(edges(spark, [("101", "202", 1e6, 0, 0), ("303", "101", 250000, 0, 0)]), "101").collect()
    assert [r.risk_drop for r in c] == [0.48, 0.12]


def test_labels_and_features(spark):
    t = spark.createDataFrame([("101", 1), ("202", 0), ("101", 0)], "account_id string, is_suspicious_tx int")
    got = by(learn.attach_labels(spark.createDataFrame([("101", 0.5, 1), ("202", 0.1, 1), ("303", 0.2, 1)], "account_id string, pagerank double, same int"), t))
    assert [got[a].is_suspicious for a in ("101", "202", "303")] == [1, 0, 0]
    assert learn.feature_columns(spark.createDataFrame([("1", 0.5, 1), ("2", 0.1, 1)], "account_id string, pagerank double, same int")) == ["pagerank"]


def test_null_times_self_loops_and_empty(spark):
    e = edges(spark, [("a", "a", 5, None, 0), ("a", "b", 5, None, 0)])
    assert flow.hawkes(e).count() == 0 and by(flow.flow_features(e))["a"].in_volume == 5
    empty = e.limit(0)
    for got in (flow.flow_features(empty), graph.motif_fans(empty), graph.pagerank(empty), typology.carousel(empty), typology.ghost_flow(empty)):
        assert got.count() == 0


def test_csv_and_normalising(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Sender_account,Receiver_account,amount_local_npr,cross_border_flag,Date,Time\n1,2,10,1,2023-01-01,10:00:00\n1,3,,0,bad,x\n")
    e = by(ledger.normalise_transactions(ledger.read_csv(spark, [str(tmp_path / "no.csv"), str(p)])), "dst")
    assert e["2"].amount == 10 and e["2"].us == 1672567200000000 and e["3"].amount == 0 and e["3"].us is None


def test_xml_reports(spark, tmp_path):
    (tmp_path / "r1.xml").write_text("<report><reason>Wire abroad</reason><transaction><t_to><to_person><first_name>Ann</first_name><last_name>Lee</last_name><tax_number>0012</tax_number></to_person></t_to></transaction></report>")
    (tmp_path / "r2.xml").write_text("<report><broken")
    r = ledger.read_reports(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].report_id, r[0].first_name, r[0].tax_number, r[0].narrative) == ("r1", "Ann", "0012", "Wire abroad")


def test_xml_people_at_any_depth_and_the_first_long_text(spark, tmp_path):
    long = "The client moved funds between accounts without any purpose that could be seen. " * 3
    (tmp_path / "r3.xml").write_text(f"<report><note>short</note><body><x>{long}</x></body><a><b><t_person><first_name>Bo</first_name></t_person></b><t_person><last_name>Ray</last_name></t_person></a></report>")
    (tmp_path / "other.txt").write_text("<report><t_person><first_name>No</first_name></t_person></report>")
    r = sorted((x.report_id, x.first_name, x.last_name, x.narrative) for x in ledger.read_reports(spark, str(tmp_path)).collect())
    assert r == [("r3", "", "Ray", long.strip()), ("r3", "Bo", "", long.strip())]


def test_xml_files_of_many_reports(spark, tmp_path):
    """CDATA and comments, several reports a file, and a file that is read in splits."""
    person = lambda n: f"<t_person><first_name>{n}</first_name></t_person>"
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?><all><report id='1'>{person('<![CDATA[A & <B>]]>')}<!-- {person('None')} --></report>\n<report><note><![CDATA[{person('None')}]]></note>{person('C')}</report></all>")
    assert sorted(r.first_name for r in ledger.read_reports(spark, str(tmp_path)).collect()) == ["A & <B>", "C"]
    (tmp_path / "big.xml").write_text("<all>" + "".join(f"<report><report_id>{i}</report_id>{person(f'n{i}')}{'<x>y</x>' * 50}</report>\n" for i in range(3000)) + "</all>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        t = ledger.read_reports(spark, str(tmp_path))
        assert t.rdd.getNumPartitions() > 4
        assert sorted(r.first_name for r in t.collect()) == sorted(["A & <B>", "C", *(f"n{i}" for i in range(3000))])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_countries_come_from_transactions(spark):
    rows = spark.createDataFrame([(1, 2, 5.0, "B1", None, "NP", "IN"), (2, 1, 5.0, "B2", "B1", "IN", "NP")], "Sender_account long, Receiver_account long, Amount double, sender_institution string, receiver_institution string, Sender_bank_location string, Receiver_bank_location string")
    a = spark.createDataFrame([("1", "X Y", "BR1", "B1")], "account_id string, name string, branch string, institution string")
    e = ledger.normalise_transactions(rows, with_places=True)
    nodes, links = flow.multigraph(a, e)
    assert sorted((r.source, r.target) for r in links.where("relation = 'LOCATED_IN'").collect()) == [("1", "BR1"), ("B1", "NP"), ("B2", "IN"), ("BR1", "B1"), ("UNKNOWN_BANK", "IN")]
    assert {r.id for r in nodes.where("type = 'Country'").collect()} == {"NP", "IN"} and {r.id for r in nodes.where("type = 'Bank'").collect()} == {"B1", "B2", "UNKNOWN_BANK"}
    old = flow.multigraph(a, e.drop("src_bank"))[1]
    assert ("B1", "NP") in {(r.source, r.target) for r in old.collect()}


def test_payroll_hub_counts_its_branch(spark):
    """Nine payments and the link to its branch make a registered account a hub."""
    rows = [("hub", f"m{i}", 100.0, 0, 0) for i in range(9)] + [(f"m{i}", "t", 100.0, 1, 0) for i in range(9)]
    e = edges(spark, rows)
    f = spark.createDataFrame([("hub", 1.0)] + [(f"m{i}", 1.0) for i in range(9)], "account_id string, flow_ratio double")
    assert {r.account_id for r in typology.ghost_payroll(e, f, volume=10.0).collect()} == {"hub", "t"}
    assert typology.ghost_payroll(e, f.where("account_id <> 'hub'"), volume=10.0).count() == 0


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.5, None)], "account_id string, risk_score double, note string")
    done = sinks.save({"scores": scores, "alerts": scores.limit(0), "metrics": scores}, str(tmp_path))
    assert done == ["risk_scores", "model_metrics"] and spark.read.option("header", True).csv(str(tmp_path / "risk_scores.csv")).first().account_id == "a"
    assert spark.read.text(str(tmp_path / "model_metrics.json")).first().value == '{"account_id":"a","note":null,"risk_score":0.5}'
    accounts = spark.createDataFrame([(1, None, "B"), (2, "X", None)], "account_id long, name string, institution string")
    tx = spark.createDataFrame([(1, 2, 5.0, None), (1, 9, 5.0, "USD")], "Sender_account long, Receiver_account long, amount_local_npr double, Payment_currency string")
    sinks.write_graph(accounts, tx, str(tmp_path / "g"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "g/nodes")).collect())) == [("1", "Unknown Entity", "B", 0.0), ("2", "X", "KYC Pending", 0.0)]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "g/edges")).select("source", "target", "currency", "cross_border").collect()] == [("1", "2", "NPR", 0)]


def test_features_by_preference(spark, tmp_path):
    (tmp_path / "ml.csv").write_text("Sender_account,Receiver_account,Amount,Is_laundering\na,b,10,1\nb,c,5,0\n")
    got = by(ledger.read_features(spark, str(tmp_path / "none.csv"), str(tmp_path / "ml.csv")))
    assert got["b"].received_amount_sum == 10 and got["b"].is_suspicious == 1 and got["c"].is_suspicious == 0
    (tmp_path / "node.csv").write_text("account_id,x\na,1.5\n")
    assert ledger.read_features(spark, str(tmp_path / "node.csv"), str(tmp_path / "ml.csv")).first().x == 1.5


def test_attributions_add_up_to_the_margin(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x, y = r.normal(size=200), r.normal(size=200)
    kind = r.choice(["p", "q", "r"], 200)
    rows = [(f"a{i}", float(x[i]), float(y[i]), str(kind[i]), int(x[i] + (kind[i] == "q") * 2 + 0.3 * r.normal() > 0.8)) for i in range(200)]
    d = spark.createDataFrame(rows, "account_id string, x double, y double, kind string, is_suspicious int")
    scores, model, cols = learn.train_and_score(d, trees=8, depth=3, rate=0.3)
    got = {}
    for row in learn.tree_shap(model, learn.model_input(d, cols)).collect():
        got.setdefault(row.account_id, {})[row.feature] = row.shap_value
    margin = {r.account_id: np.log(r.risk_score / (1 - r.risk_score)) / 2 for r in scores.collect()}  # the trees' sum, as the model squashes twice of it
    base = [margin[a] - sum(got[a].values()) for a in margin]
    assert set(cols) == {"x", "y", "kind"} and max(base) - min(base) < 1e-9 and np.mean([abs(v["kind"]) for v in got.values()]) > 0.05
    top = learn.importance(model, cols)
    assert {n for n, _, _ in top[:2]} == {"x", "kind"} and sum(g for _, g, _ in top) == pytest.approx(1)
    # against all subsets on one path: two features, one of them tested twice
    o, z = [np.array([1.0]), np.array([0.0]), np.array([1.0])], [0.5, 0.25, 0.1]
    from itertools import combinations
    from math import factorial

    v = lambda s: np.prod([o[i][0] if i in s else z[i] for i in range(3)])
    want = [sum(factorial(k) * factorial(2 - k) / 6 * (v({*s, j}) - v(set(s))) for k in range(3) for s in combinations([i for i in range(3) if i != j], k)) for j in range(3)]
    assert [float(p[0]) for p in learn.leaf_shares(o, z)] == pytest.approx(want)


def test_labels_under_any_known_name(spark):
    f = spark.createDataFrame([("1",), ("2",)], "account_id string")
    y = spark.createDataFrame([(1, 1), (2, None)], "Sender_account long, Is_laundering int")
    assert {r.account_id: r.is_suspicious for r in learn.attach_labels(f, y).collect()} == {"1": 1, "2": 0}


def test_leiden_finds_planted_communities(spark):
    import numpy as np

    r = np.random.default_rng(1)
    n, k = 60, 4
    pairs = {(i, j) for i in range(n) for j in range(i) if r.random() < (0.5 if i % k == j % k else 0.03)}
    e = edges(spark, [(f"{i:02d}", f"{j:02d}", 1, 0, 0) for i, j in sorted(pairs)])
    a = spark.createDataFrame([(f"{i:02d}",) for i in range(n)] + [("alone",)], "account_id string")
    c = {r.account_id: r.community_id for r in graph.leiden(e, a).collect()}
    assert len(c) == n + 1 and c["alone"] == "alone"

    def modularity(of):
        deg, m = [0] * n, len(pairs)
        for i, j in pairs:
            deg[i] += 1
            deg[j] += 1
        same = sum(of(i) == of(j) for i, j in pairs) / m
        return same - sum((sum(deg[i] for i in range(n) if of(i) == g) / (2 * m)) ** 2 for g in {of(i) for i in range(n)})

    assert modularity(lambda i: c[f"{i:02d}"]) >= modularity(lambda i: i % k) - 0.01


def test_pagerank_plan_does_not_grow(small):
    plan = graph.pagerank(small, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3


def test_sentence_case(spark):
    got = spark.createDataFrame([("rapid_MOVEMENT of",), ("",), (None,)], "x string").select(sentence_case(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["Rapid movement of", "", None]


def test_joins_on_buckets_find_what_plain_joins_find(spark):
    """Pairs on both sides of bucket borders, times before 1970, null times, null and negative amounts."""
    import random
    from itertools import product

    from ledgerlens.operators import graph, typology

    rng, day, names = random.Random(5), 86_400_000_000, "abcdef"
    times = [k * day + x for k in (-2, -1, 0, 1, 2) for x in (-1, 0, 1)]
    rows = [(i, *rng.sample(names, 2), rng.choice([100.0, 97.0, 103.0, 99.999999, -100.0, -98.0, 0.0, None]), rng.choice([*times, None]), 0) for i in range(90)]
    e = spark.createDataFrame(rows, "tx_id long, src string, dst string, amount double, us long, cb int")
    timed = [r for r in rows if r[4] is not None]
    want = dict.fromkeys(names, (0, 0))
    for p, q, r in product(timed, timed, timed):
        if p[2] == q[1] and p[4] < q[4] <= p[4] + day and p[1] != q[2] and {r[1], r[2]} == {p[1], q[2]} and q[4] < r[4] <= p[4] + day:
            for k in (p[1], p[2], q[2]):
                t, c = want[k]
                want[k] = (t + (r[1] == p[1]), c + (r[1] != p[1]))
    got = {r.account_id: (r.motif_triangle, r.motif_cycle) for r in graph.motif_triangles_cycles(e).collect()}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}
    feats = spark.createDataFrame([(k, 1.0, 1e6) for k in names], "account_id string, flow_ratio double, out_volume double")
    ends = set()

    def grow(path, last):
        if len(path) >= 3:
            ends.add(path[-1])
        for r in rows if len(path) < 4 else ():
            near = last[3] is not None and r[3] is not None and 0.97 <= r[3] / (last[3] + 1e-9) <= 1.03
            if r[1] == path[-1] and r[2] not in path and near and (r[4] is None or last[4] is None or last[4] <= r[4] <= last[4] + 3 * day):
                grow([*path, r[2]], r)

    for r in rows:
        grow([r[1], r[2]], r)
    assert {r.account_id for r in typology.layering(e, feats, max_nodes=4).collect()} == ends


def test_attention_over_metapaths_by_hand(spark):
    """Against whole matrices; an account without a branch or a name keeps its row."""
    import numpy as np

    from ledgerlens.operators import embed

    rows = [("1", "x", "B1"), ("2", "x", "B2"), ("3", "", "B1"), ("4", None, None)]
    values = [(0.9, 0.1, 0.4, 0.3), (1.1, 0.5, 0.1, 0.0), (1.0, 0.0, 0.2, 0.9), (0.2, 0.3, 0.3, 0.1)]
    accounts = spark.createDataFrame(rows, "account_id string, name string, branch string")
    feats = spark.createDataFrame([(r[0], *v) for r, v in zip(rows, values)], "account_id string, flow_ratio double, tps_score double, pagerank double, hawkes_intensity double")
    got = {r.account_id: r.embedding for r in embed.han(accounts, feats, dim=4).collect()}
    w = lambda i, j, seed: np.sin(12.9898 * i + 78.233 * j + seed)
    h = np.array(values) @ np.array([[w(i, j, 1.0) * 0.5 for j in range(4)] for i in range(4)])
    same = lambda keys: np.array([[float(a is not None and a == b) for b in keys] for a in keys])
    paths = []
    for keys in ([r[1] or r[0] for r in rows], [r[2] for r in rows]):
        m = same(keys)
        paths.append(m / np.maximum(m.sum(1, keepdims=True), 1) @ h)
    q = np.array([w(0, k, 7.0) for k in range(4)])
    e = np.exp([np.mean(np.tanh(z) @ q) for z in paths])
    want = (e[0] * paths[0] + e[1] * paths[1]) / e.sum()
    assert sorted(got) == ["1", "2", "3", "4"] and all(got[r[0]] == pytest.approx(list(x)) for r, x in zip(rows, want))
