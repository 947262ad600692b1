"""Every query of the engine with its SQL twin.

Queries run over whole tables; thresholds are rescaled to the ledger's amounts where the defaults, made for
real currency, would find nothing. Derived doubles are rounded to six places in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import risk_band
from ledgerlens.operators import embed, flow, graph, learn, risk, text, typology
from ledgerlens.plans import serve
from ledgerlens.plans.point import LedgerIndex
from ledgerlens.sources import ledger
from ledgerlens.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ACCOUNT = "7"
#: An account with claims.
CLAIMANT = "10"
#: Claim rules for invented prose, which the default words don't match.
PROSE_CLAIMS = (("cross_border_activity", "licen[sc]e|copyright"), ("high_volume", "secret|password|token"), ("rapid_movement", "@"))


def query(sql: str | None = None, base: str = ledger.EVENT_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            whole = (base + ", " if base and not sql.lstrip().startswith("SELECT") else base + " ") + sql.strip()
            ORACLES[f.__name__] = whole.strip() if whole.lstrip().startswith("SELECT") else "WITH RECURSIVE " + whole
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ev(spark: SparkSession, d: str) -> DataFrame:
    return ledger.event_ledger(spark, d)


def acc(spark: SparkSession, d: str) -> DataFrame:
    return ledger.event_accounts(spark, d)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def communities(accounts: DataFrame) -> DataFrame:
    """A given community map: seven groups by id."""
    return accounts.select("account_id", (F.col("account_id").cast("long") % 7).alias("community_id"))


def core(spark: SparkSession, d: str) -> DataFrame:
    return flow.core_features(acc(spark, d), ev(spark, d), threshold=100.0)


AMT = "CAST(amount AS DECIMAL(28,6))"
FLOW = f"""
b AS (SELECT src AS k, dst AS o, 1 AS out, amount, us, cb FROM e UNION ALL SELECT dst, src, 0, amount, us, cb FROM e),
fl AS (SELECT k, coalesce(CAST(sum({AMT}) FILTER (out = 0) AS DOUBLE), 0) vin, coalesce(CAST(sum({AMT}) FILTER (out = 1) AS DOUBLE), 0) vout,
              CAST(count(*) FILTER (out = 0) AS BIGINT) din, CAST(count(*) FILTER (out = 1) AS BIGINT) dout FROM b GROUP BY k),
ff AS (SELECT *, vout / (vin + 1e-5) fr, CASE WHEN vin + vout = 0 THEN 0 ELSE abs(vout - vin) / (vin + vout + 1e-5) END dfa FROM fl),
hm AS (SELECT k, us, max(us) OVER (PARTITION BY k) mx FROM b WHERE us IS NOT NULL),
hw AS (SELECT k, 0.01 + 0.5 * (sum(exp(-((mx - us) / 3.6e9))) - 1) hi FROM hm GROUP BY k),
tp AS (SELECT src k, count(*) FILTER (amount >= 90.0 AND amount < 100.0) / count(*)::DOUBLE tps, CAST(count(DISTINCT dst) FILTER (amount >= 90.0 AND amount < 100.0) AS BIGINT) br FROM e GROUP BY src),
cf AS (SELECT account_id, acct_type, coalesce(vin, 0.0) vin, coalesce(vout, 0.0) vout, coalesce(fr, 0.0) fr, coalesce(dfa, 0.0) dfa, coalesce(din, 0) din, coalesce(dout, 0) dout, coalesce(hi, 0.0) hi, coalesce(tps, 0.0) tps, coalesce(br, 0) br
       FROM a LEFT JOIN ff ON ff.k = account_id LEFT JOIN hw ON hw.k = account_id LEFT JOIN tp ON tp.k = account_id)
"""


@query(FLOW + " SELECT k AS account_id, round(vin, 6) AS in_volume, round(vout, 6) AS out_volume, din AS in_degree, dout AS out_degree, round(fr, 6) AS flow_ratio, round(dfa, 6) AS dfa_score FROM ff")
def flow_features(spark, d):
    return rounded(flow.flow_features(ev(spark, d)))


@query(FLOW + " SELECT k AS account_id, round(hi, 6) AS hawkes_intensity FROM hw")
def hawkes(spark, d):
    return rounded(flow.hawkes(ev(spark, d)))


@query(FLOW + " SELECT k AS account_id, round(tps, 6) AS tps_score, br AS band_recipients FROM tp")
def tps(spark, d):
    return rounded(flow.tps(ev(spark, d), threshold=100.0))


@query(FLOW + """ SELECT account_id, acct_type, round(vin, 6) AS in_volume, round(vout, 6) AS out_volume, din AS in_degree, dout AS out_degree, round(fr, 6) AS flow_ratio, round(dfa, 6) AS dfa_score,
       round(hi, 6) AS hawkes_intensity, round(tps, 6) AS tps_score, br AS band_recipients FROM cf""")
def feature_matrix(spark, d):
    return rounded(core(spark, d))


@query(FLOW + " SELECT k AS account_id, din AS in_degree, dout AS out_degree, din + dout AS degree FROM ff")
def degrees(spark, d):
    return graph.degrees(ev(spark, d))


TR_SQL = """
nc AS (SELECT count(*) n FROM customer),
e AS (SELECT CAST(o_custkey AS VARCHAR) src, CAST(l_partkey % n AS VARCHAR) dst, l_extendedprice amount, epoch_us(l_shipdate) us, CAST(coalesce(s.c_nationkey <> r.c_nationkey, false) AS INTEGER) cb
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey, nc LEFT JOIN customer s ON s.c_custkey = o_custkey LEFT JOIN customer r ON r.c_custkey = l_partkey % n)
"""


@query("SELECT src AS account_id, count(*) AS n_tx, round(CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE), 6) AS out_volume, CAST(sum(cb) AS BIGINT) AS n_cross_border, count(DISTINCT dst) AS receivers FROM e GROUP BY src", TR_SQL)
def order_ledger_flows(spark, d):
    e = ledger.order_ledger(spark, d)
    return rounded(e.groupBy(F.col("src").alias("account_id")).agg(F.count("*").alias("n_tx"), flow.money_sum("amount").alias("out_volume"), F.sum("cb").cast("long").alias("n_cross_border"), F.count_distinct("dst").alias("receivers")))


def pagerank_sql(k: int) -> str:
    steps = ["x0 AS (SELECT k, 1.0 / nn.n x FROM nodes, nn)"]
    for i in range(k):
        steps.append(f"""x{i + 1} AS (SELECT nodes.k, 0.85 * (coalesce(f, 0) + d / nn.n) + 0.15 / nn.n x FROM nodes LEFT JOIN (SELECT dst k, sum(p * x) f FROM el JOIN x{i} ON x{i}.k = el.src GROUP BY dst) q ON q.k = nodes.k, nn,
            (SELECT coalesce(sum(x), 0) d FROM x{i} WHERE k NOT IN (SELECT src FROM el)))""")
    return ("c AS (SELECT src, dst, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) w FROM e GROUP BY ALL), el AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) p FROM c), "
            "nodes AS (SELECT src k FROM e UNION SELECT dst FROM e), nn AS (SELECT count(*) n FROM nodes), " + ", ".join(steps))


PR = pagerank_sql(10)


@query(PR + " SELECT k AS account_id, round(x, 8) AS pagerank FROM x10")
def pagerank_k10(spark, d):
    return rounded(graph.pagerank(ev(spark, d)), 8)


@query("""SELECT id, type FROM (SELECT account_id id, 'Account' type FROM a UNION SELECT CASE WHEN name <> '' THEN 'cust_' || replace(name, ' ', '_') ELSE 'cust_' || account_id END, 'Customer' FROM a
          UNION SELECT branch, 'Branch' FROM a UNION SELECT institution, 'Bank' FROM a UNION SELECT 'NP', 'Country' FROM a)""")
def graph_nodes(spark, d):
    return flow.multigraph(acc(spark, d), ev(spark, d))[0]


@query("""r AS (SELECT 'SENDS' relation, src source, dst target, amount FROM e UNION ALL SELECT 'OWNS', CASE WHEN name <> '' THEN 'cust_' || replace(name, ' ', '_') ELSE 'cust_' || account_id END, account_id, NULL FROM a
          UNION ALL SELECT 'LOCATED_IN', account_id, branch, NULL FROM a UNION ALL SELECT 'LOCATED_IN', branch, institution, NULL FROM a UNION ALL SELECT 'LOCATED_IN', institution, 'NP', NULL FROM a)
          SELECT relation, source, count(*) AS n, round(CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE), 6) AS amount FROM r GROUP BY relation, source""")
def graph_edges(spark, d):
    e = flow.multigraph(acc(spark, d), ev(spark, d))[1]
    return rounded(e.groupBy("relation", "source").agg(F.count("*").alias("n"), flow.money_sum("amount").alias("amount")))


@query(TR_SQL.rstrip() + """, ac AS (SELECT CAST(u.user_id AS VARCHAR) account_id, 'BR' || (u.user_id % 7) branch, 'BANK' || (u.user_id % 3) institution FROM (SELECT DISTINCT user_id FROM events) u),
ct AS (SELECT o_custkey a, l_partkey % n b FROM orders JOIN lineitem ON o_orderkey = l_orderkey, nc), en AS (SELECT a k FROM ct UNION SELECT b FROM ct),
pl AS (SELECT DISTINCT 'BANK' || (k % 5) bank, coalesce('C' || c_nationkey, 'NP') country FROM en LEFT JOIN customer ON c_custkey = k)
SELECT source, target, count(*) AS n FROM (SELECT account_id source, branch target FROM ac UNION ALL SELECT branch, institution FROM ac UNION ALL SELECT bank, country FROM pl) GROUP BY ALL""", "")
def graph_places(spark, d):
    """Where accounts, branches and the transactions' banks lie."""
    e = flow.multigraph(acc(spark, d), ledger.order_ledger(spark, d, with_places=True))[1]
    return e.where("relation = 'LOCATED_IN'").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""SELECT account_id, min(reason) AS reason FROM (SELECT account_id, 'keyword' reason FROM a WHERE regexp_matches(upper(name), 'GOVERNMENT|TAX|TELECOM|UTILITY|CLEARINGHOUSE|MINISTRY|MUNICIPALITY|REVENUE|HOSPITAL|UNIVERSITY')
          UNION ALL SELECT dst, 'receipts' FROM e GROUP BY dst HAVING count(*) > 65) GROUP BY account_id""")
def whitelist(spark, d):
    return flow.whitelist(acc(spark, d), ev(spark, d), receipts=65)


MOTIF = """
p AS (SELECT x.src u, x.dst v, y.dst w, y.us t2, x.us + 86400000000 hi FROM e x JOIN e y ON x.dst = y.src AND y.us > x.us AND y.us <= x.us + 86400000000 AND y.dst <> x.src),
h AS (SELECT u, v, w, 1 tri FROM p JOIN e z ON z.src = p.u AND z.dst = p.w AND z.us > p.t2 AND z.us <= p.hi UNION ALL SELECT u, v, w, 0 FROM p JOIN e z ON z.src = p.w AND z.dst = p.u AND z.us > p.t2 AND z.us <= p.hi),
mt AS (SELECT k, CAST(sum(tri) AS BIGINT) tri, CAST(sum(1 - tri) AS BIGINT) cyc FROM (SELECT u k, tri FROM h UNION ALL SELECT v, tri FROM h UNION ALL SELECT w, tri FROM h) GROUP BY k)
"""


@query(MOTIF + " SELECT k AS account_id, tri AS motif_triangle, cyc AS motif_cycle FROM mt")
def motif_triangles_cycles(spark, d):
    return graph.motif_triangles_cycles(ev(spark, d))


@query("""o AS (SELECT src hub, dst o, us, row_number() OVER (PARTITION BY src ORDER BY us, tx_id) r FROM e), i AS (SELECT dst hub, src o, us, row_number() OVER (PARTITION BY dst ORDER BY us, tx_id) r FROM e),
po AS (SELECT x.hub, x.o a, y.o b FROM o x JOIN o y ON x.hub = y.hub AND y.r > x.r AND y.r <= x.r + 100 AND y.us - x.us <= 86400000000 AND x.o <> y.o),
pi AS (SELECT x.hub, x.o a, y.o b FROM i x JOIN i y ON x.hub = y.hub AND y.r > x.r AND y.r <= x.r + 100 AND y.us - x.us <= 86400000000 AND x.o <> y.o),
u AS (SELECT hub k, 1 f, 0 g FROM po UNION ALL SELECT a, 1, 0 FROM po UNION ALL SELECT b, 1, 0 FROM po UNION ALL SELECT hub, 0, 1 FROM pi UNION ALL SELECT a, 0, 1 FROM pi UNION ALL SELECT b, 0, 1 FROM pi)
SELECT k AS account_id, CAST(sum(f) AS BIGINT) AS motif_fanout, CAST(sum(g) AS BIGINT) AS motif_fanin FROM u GROUP BY k""")
def motif_fans(spark, d):
    return graph.motif_fans(ev(spark, d))


@query("SELECT CAST(CAST(src AS BIGINT) % 7 AS BIGINT) AS community_id, round(avg(cb), 6) AS comm_cb_ratio FROM e GROUP BY ALL")
def community_cb_ratio(spark, d):
    return rounded(graph.community_cb_ratio(ev(spark, d), communities(acc(spark, d))))


@query("""s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), m AS (SELECT u, v, count(*) m FROM (SELECT src u, dst v FROM s UNION ALL SELECT dst, src FROM s) GROUP BY ALL),
p AS (SELECT u, v, m / sum(m) OVER (PARTITION BY u) p FROM m), t AS (SELECT x.u, y.v, sum(x.p * y.p) q FROM p x JOIN p y ON x.v = y.u AND x.u <> y.v GROUP BY ALL),
c AS (SELECT p.u, sum(pow(p.p + coalesce(q, 0), 2)) c FROM p LEFT JOIN t ON t.u = p.u AND t.v = p.v GROUP BY p.u)
SELECT account_id, round(CASE WHEN c.u IS NULL OR account_id NOT IN (SELECT src FROM s) THEN 1.0 ELSE c END, 6) AS structural_constraint FROM a LEFT JOIN c ON c.u = account_id""")
def burt_constraint(spark, d):
    return rounded(graph.burt_constraint(ev(spark, d), acc(spark, d)))


SCAN_SQL = """
und AS (SELECT DISTINCT least(src, dst) u, greatest(src, dst) v FROM e WHERE src <> dst AND src IN (SELECT account_id FROM a) AND dst IN (SELECT account_id FROM a)),
nb AS (SELECT u k, v o FROM und UNION ALL SELECT v, u FROM und), dg AS (SELECT k, count(*) d FROM nb GROUP BY k),
sm AS (SELECT u, v FROM (SELECT u, v, (SELECT count(*) FROM nb x JOIN nb y ON x.o = y.o WHERE x.k = und.u AND y.k = und.v) c FROM und) q JOIN dg a1 ON a1.k = u JOIN dg a2 ON a2.k = v WHERE (c + 2) / sqrt((a1.d + 1) * (a2.d + 1) + 1e-9) >= 0.3),
ep AS (SELECT u k, v o FROM sm UNION ALL SELECT v, u FROM sm), co AS (SELECT k FROM ep GROUP BY k HAVING count(*) + 1 >= 3),
re AS (SELECT k, k r FROM co UNION SELECT ep.o, re.r FROM re JOIN ep ON ep.k = re.k WHERE ep.o IN (SELECT k FROM co)),
cc AS (SELECT k, min(r) root FROM re GROUP BY k), bo AS (SELECT ep.k, max(root) root FROM ep JOIN cc ON cc.k = ep.o WHERE ep.k NOT IN (SELECT k FROM co) GROUP BY ep.k),
me AS (SELECT * FROM cc UNION ALL SELECT * FROM bo), se AS (SELECT nb.k, count(DISTINCT root) n FROM nb JOIN me ON me.k = nb.o GROUP BY nb.k)
SELECT account_id, coalesce(root, CASE WHEN n >= 2 THEN 'HUB' ELSE 'OUTLIER' END) AS scan_cluster FROM a LEFT JOIN me ON me.k = account_id LEFT JOIN se ON se.k = account_id
"""


@query(SCAN_SQL)
def scan_clusters(spark, d):
    return graph.scan(ev(spark, d), acc(spark, d), epsilon=0.3)


@query("""ac AS (SELECT * FROM e WHERE src IN (SELECT account_id FROM a) AND dst IN (SELECT account_id FROM a)), q AS (SELECT quantile_cont(amount, 0.1) lo, quantile_cont(amount, 0.98) hi FROM ac),
t AS (SELECT i, lo + (hi - lo) * i / 9 t FROM q, range(10) r(i)), w AS (SELECT least(src, dst) u, greatest(src, dst) v, max(amount) w FROM ac WHERE src <> dst GROUP BY ALL),
pr AS (SELECT i, u k, v o FROM w, t WHERE w >= t.t UNION ALL SELECT i, v, u FROM w, t WHERE w >= t.t), nd AS (SELECT i, account_id k FROM a, t),
re AS (SELECT i, k, k r FROM nd UNION SELECT re.i, pr.o, re.r FROM re JOIN pr ON pr.i = re.i AND pr.k = re.k), cc AS (SELECT i, k, min(r) root FROM re GROUP BY i, k),
sz AS (SELECT i, root, count(*) n FROM cc GROUP BY ALL), lf AS (SELECT root, n, min(t.t) b, max(t.t) dd FROM sz JOIN t USING (i) GROUP BY ALL),
mi AS (SELECT DISTINCT k, root, n FROM cc JOIN sz USING (i, root)), bs AS (SELECT k, b, dd, dd - b p, row_number() OVER (PARTITION BY k ORDER BY dd - b DESC, b) r FROM mi JOIN lf USING (root, n))
SELECT k AS account_id, round(b, 6) AS betti_birth, round(dd, 6) AS betti_death, round(p, 6) AS betti_persistence FROM bs WHERE r = 1""")
def betti_persistence(spark, d):
    return rounded(graph.betti_persistence(ev(spark, d), acc(spark, d)))


SUB = f"""one AS (SELECT * FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}'), nr AS (SELECT DISTINCT k FROM (SELECT src k FROM one UNION SELECT dst FROM one) WHERE k <> '{ACCOUNT}'),
al AS (SELECT src, dst, us, min(amount) amount FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}' OR src IN (SELECT k FROM nr) OR dst IN (SELECT k FROM nr) GROUP BY ALL)
SELECT src, dst, us, amount, CASE WHEN src = '{ACCOUNT}' THEN 'target' WHEN src IN (SELECT k FROM nr) THEN 'intermediary' ELSE 'destination' END AS role_source,
       CASE WHEN dst = '{ACCOUNT}' THEN 'target' WHEN dst IN (SELECT k FROM nr) THEN 'intermediary' ELSE 'destination' END AS role_target FROM al ORDER BY us, src, dst LIMIT 200"""


@query(SUB)
def subgraph_2hop(spark, d):
    return graph.two_hop_subgraph(ev(spark, d), ACCOUNT)


@query(f"""f1 AS (SELECT '{ACCOUNT}' k UNION SELECT dst FROM s WHERE src = '{ACCOUNT}' UNION SELECT src FROM s WHERE dst = '{ACCOUNT}'),
f2 AS (SELECT k FROM f1 UNION SELECT dst FROM s WHERE src IN (SELECT k FROM f1) UNION SELECT src FROM s WHERE dst IN (SELECT k FROM f1))
SELECT tx_id, src, dst, amount, us, cb FROM s WHERE src IN (SELECT k FROM f2) AND dst IN (SELECT k FROM f2)""".replace("f1 AS", "s AS (SELECT * FROM e), f1 AS", 1))
def ego_subgraph(spark, d):
    return graph.ego_subgraph(ev(spark, d), ACCOUNT)


@query(f"SELECT count(*) AS n, round(CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE), 6) AS amount FROM (SELECT * FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}' ORDER BY us, tx_id LIMIT 2500)")
def account_transactions(spark, d):
    t = ledger.transactions_of(ev(spark, d), ACCOUNT)
    return rounded(t.agg(F.count("*").alias("n"), flow.money_sum("amount").alias("amount")))


@query(f"""h1 AS (SELECT 1 hop, src, dst, amount FROM e WHERE src = '{ACCOUNT}' AND dst <> '{ACCOUNT}' ORDER BY amount DESC, tx_id LIMIT 1),
h2 AS (SELECT 2 hop, src, dst, amount FROM e WHERE src IN (SELECT dst FROM h1) AND dst <> src AND dst <> '{ACCOUNT}' ORDER BY amount DESC, tx_id LIMIT 1)
SELECT CAST(hop AS INTEGER) AS hop, src, dst, amount FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""")
def alluvial_path(spark, d):
    return graph.alluvial_path(ev(spark, d), ACCOUNT)


# ---- alerts

LAYER = """st AS (SELECT account_id k FROM cf WHERE fr >= 0.97 AND vout > 1000),
pa AS (SELECT dst last, [src, dst] path, amount, us, 2 n FROM e WHERE src IN (SELECT k FROM st) AND src <> dst AND dst IN (SELECT account_id FROM a)
       UNION ALL SELECT e.dst, list_append(pa.path, e.dst), e.amount, e.us, pa.n + 1 FROM pa JOIN e ON e.src = pa.last WHERE pa.n < 6 AND NOT list_contains(pa.path, e.dst) AND e.us BETWEEN pa.us AND pa.us + 259200000000
       AND e.amount / (pa.amount + 1e-9) BETWEEN 0.97 AND 1.03 AND e.dst IN (SELECT account_id FROM a)),
la AS (SELECT last account_id, min(array_to_string(path, ' -> ')) dt FROM pa WHERE n >= 3 GROUP BY last)"""


@query(FLOW + "," + LAYER + " SELECT account_id, 'Layering Chain' AS typology, CAST(0.95 AS DOUBLE) AS confidence, dt AS details FROM la")
def layering_chains(spark, d):
    return typology.layering(ev(spark, d), core(spark, d), start_volume=1000.0)


@query(FLOW + " SELECT account_id, 'Structuring Star' AS typology, round(least(0.7 + 0.3 * tps, 0.99), 6) AS confidence, br || ' receivers below the threshold' AS details FROM cf WHERE br >= 3 AND tps > 0.05")
def structuring_stars(spark, d):
    return rounded(typology.structuring(core(spark, d), min_share=0.05))


CYCLES = """l AS (SELECT * FROM (SELECT src, dst, amount, us, row_number() OVER (PARTITION BY src, dst ORDER BY us DESC, tx_id DESC) r FROM e WHERE src <> dst) WHERE r = 1),
cp AS (SELECT [src] p, src s, dst last, us t0, us t, amount lo, amount hi, 1 n FROM l
       UNION ALL SELECT list_append(p, l.src), s, l.dst, t0, l.us, least(lo, l.amount), greatest(hi, l.amount), n + 1 FROM cp JOIN l ON l.src = cp.last
       WHERE n < 6 AND cp.last <> s AND NOT list_contains(p, l.src) AND l.us >= t AND l.us <= t0 + 259200000000 AND least(lo, l.amount) / greatest(hi, l.amount) >= 0.5),
cy AS (SELECT k, min(array_to_string(p, ' -> ')) dt FROM (SELECT p, unnest(p) k FROM cp WHERE last = s AND n BETWEEN 3 AND 6) GROUP BY k)"""


@query(CYCLES + " SELECT k AS account_id, 'Carousel Cycle' AS typology, CAST(0.94 AS DOUBLE) AS confidence, dt AS details FROM cy")
def carousel_cycles(spark, d):
    return typology.carousel(ev(spark, d), max_hours=72.0, conservation=0.5)


@query(FLOW + " SELECT account_id, 'Mule Account' AS typology, CAST(0.88 AS DOUBLE) AS confidence, printf('intensity %.3f', hi) AS details FROM cf WHERE hi > 0.1 AND fr BETWEEN 0.9 AND 1.1 AND vout > 1000")
def mule_accounts(spark, d):
    return typology.mule(core(spark, d), hawkes=0.1, low=0.9, high=1.1, volume=1000.0)


ACCD = f"""ad AS (SELECT k, avg(us) FILTER (out = 0) ti, avg(us) FILTER (out = 1) t_o, count(*) FILTER (out = 0) ni, count(*) FILTER (out = 1) no, CAST(sum({AMT}) FILTER (out = 0) AS DOUBLE) vi, CAST(sum({AMT}) FILTER (out = 1) AS DOUBLE) vo FROM b GROUP BY k),
ax AS (SELECT k, vi, vo FROM ad WHERE ni >= 4 AND no >= 4 AND ti < t_o AND vo / (vi + 1e-5) BETWEEN 0.8 AND 1.2 AND vi > 500)"""


@query(FLOW + "," + ACCD + " SELECT k AS account_id, 'Accumulate and Disperse' AS typology, CAST(0.89 AS DOUBLE) AS confidence, printf('in %.2f, out %.2f', vi, vo) AS details FROM ax")
def accumulate_disperse(spark, d):
    return typology.accumulate_disperse(ev(spark, d), tolerance=0.2, volume=500.0)


GHOST = """gp AS (SELECT x.tx_id cb_tx, y.tx_id dom_tx, x.src sender, y.dst receiver FROM e x JOIN e y ON x.cb = 1 AND y.cb = 0 AND x.amount > 0 AND y.amount > 0 AND y.amount >= x.amount * (1 - 0.05) AND y.amount <= x.amount * (1 + 0.05) AND abs(y.us - x.us) <= 3600000000 AND x.src <> y.dst
       WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.src AND z.dst = y.dst) AND NOT EXISTS (SELECT 1 FROM e z WHERE z.src = y.dst AND z.dst = x.src))"""


@query(GHOST + " SELECT cb_tx, dom_tx, sender, receiver FROM gp")
def ghost_flows(spark, d):
    return typology.ghost_pairs(ev(spark, d)).select("cb_tx", "dom_tx", "sender", "receiver")


@query(GHOST + """, gc AS (SELECT gp.*, x.us, x.amount FROM gp JOIN e x ON x.tx_id = cb_tx ORDER BY x.us, cb_tx, x.amount, dom_tx LIMIT 250)
SELECT k AS account_id, 'Hawala Ghost Flow' AS typology, CAST(0.9 AS DOUBLE) AS confidence, printf('from transaction %d', min(cb_tx)) AS details FROM (SELECT sender k, cb_tx FROM gc UNION ALL SELECT receiver, cb_tx FROM gc) GROUP BY k""")
def ghost_flow_alerts(spark, d):
    """The detector with its cap of 500 alerts, in order of time."""
    return typology.ghost_flow(ev(spark, d))


LOAN = PR + """, lb AS (SELECT account_id, x FROM cf JOIN x10 ON x10.k = account_id WHERE x > 0.0001 AND fr BETWEEN 0.95 AND 1.05 AND account_id IN (SELECT p.src FROM e p JOIN e q ON p.src = q.dst AND p.dst = q.src))"""


@query(FLOW + "," + LOAN + """ SELECT account_id, 'Loan-Back' AS typology, CAST(0.80 AS DOUBLE) AS confidence, printf('pagerank %.4f', x::DOUBLE) AS details FROM lb""")
def loan_back(spark, d):
    f = core(spark, d).join(graph.pagerank(ev(spark, d)), "account_id")
    return typology.loan_back(ev(spark, d), f, pagerank=0.0001)


PAY = f"""hb AS (SELECT src k FROM e GROUP BY src HAVING count(*) >= 5 AND count(*) + CAST(src IN (SELECT account_id FROM a) AS INTEGER) >= 10), pm AS (SELECT x.tx_id pay, x.src hub, y.dst target, y.amount, row_number() OVER (PARTITION BY x.tx_id ORDER BY y.us, y.tx_id) r
      FROM e x JOIN e y ON y.src = x.dst AND y.us > x.us AND y.us <= x.us + 43200000000 WHERE x.src IN (SELECT k FROM hb) AND x.dst IN (SELECT account_id FROM cf WHERE fr BETWEEN 0.9 AND 1.1)),
pt AS (SELECT hub, target, CAST(sum({AMT}) AS DOUBLE) v FROM pm WHERE r = 1 GROUP BY ALL HAVING CAST(sum({AMT}) AS DOUBLE) > 60)"""


@query(FLOW + "," + PAY + " SELECT k AS account_id, 'Ghost Payroll' AS typology, CAST(0.92 AS DOUBLE) AS confidence, printf('volume %.2f', max(v)) AS details FROM (SELECT hub k, v FROM pt UNION SELECT target, v FROM pt) GROUP BY k")
def ghost_payroll(spark, d):
    return typology.ghost_payroll(ev(spark, d), core(spark, d), volume=60.0)


SHELL = f"""sv AS (SELECT dst k, CAST(sum({AMT}) AS DOUBLE) v, coalesce(CAST(sum({AMT}) FILTER (CAST(src AS BIGINT) % 7 = CAST(dst AS BIGINT) % 7) AS DOUBLE), 0) own FROM e GROUP BY dst)"""


@query(FLOW + "," + SHELL + " SELECT account_id, 'Shell Layering' AS typology, CAST(0.87 AS DOUBLE) AS confidence, printf('share %.3f', own / v) AS details FROM cf JOIN sv ON sv.k = account_id WHERE acct_type = 'CURRENT' AND fr > 0.95 AND own / v > 0.15 AND v > 500")
def shell_layering(spark, d):
    return typology.shell_layering(ev(spark, d), core(spark, d), communities(acc(spark, d)), share=0.15, volume=500.0)


def all_alerts(spark, d) -> DataFrame:
    """The alerts of all detectors. Each is stored before the next is looked for, so the driver holds what the joins of one broadcast, not of all at once."""
    e, f = ev(spark, d), graph.apart(graph.cut(core(spark, d)))
    found = [typology.structuring(f, min_share=0.05), typology.mule(f, hawkes=0.1, low=0.9, high=1.1, volume=1000.0), typology.layering(e, f, start_volume=1000.0)]
    found += [typology.accumulate_disperse(e, tolerance=0.2, volume=500.0), typology.ghost_payroll(e, f, volume=60.0), typology.shell_layering(e, f, communities(f), share=0.15, volume=500.0)]
    ranked = graph.apart(graph.cut(f.join(graph.pagerank(e), "account_id")))
    found = [graph.cut(x) for x in found]
    found += [graph.cut(typology.carousel(e, max_hours=72.0, conservation=0.5)), graph.cut(typology.loan_back(e, ranked, pagerank=0.0001)), graph.cut(typology.ghost_flow(e, max_alerts=None))]
    return typology.dedup(reduce(DataFrame.unionByName, found))


ALERTS = FLOW + "," + LAYER + "," + ACCD + "," + GHOST + "," + PAY + "," + SHELL + "," + CYCLES + "," + LOAN + """,
al AS (SELECT account_id, 'Structuring Star' typology, least(0.7 + 0.3 * tps, 0.99) confidence FROM cf WHERE br >= 3 AND tps > 0.05 UNION SELECT account_id, 'Mule Account', 0.88 FROM cf WHERE hi > 0.1 AND fr BETWEEN 0.9 AND 1.1 AND vout > 1000
  UNION SELECT account_id, 'Layering Chain', 0.95 FROM la UNION SELECT k, 'Accumulate and Disperse', 0.89 FROM ax UNION SELECT hub, 'Ghost Payroll', 0.92 FROM pt UNION SELECT target, 'Ghost Payroll', 0.92 FROM pt
  UNION SELECT account_id, 'Shell Layering', 0.87 FROM cf JOIN sv ON sv.k = account_id WHERE acct_type = 'CURRENT' AND fr > 0.95 AND own / v > 0.15 AND v > 500
  UNION SELECT k, 'Carousel Cycle', 0.94 FROM cy UNION SELECT account_id, 'Loan-Back', 0.8 FROM lb
  UNION SELECT sender, 'Hawala Ghost Flow', 0.9 FROM gp UNION SELECT receiver, 'Hawala Ghost Flow', 0.9 FROM gp)"""


@query(ALERTS + " SELECT account_id, typology, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM al")
def alerts_dedup(spark, d):
    return rounded(all_alerts(spark, d).drop("details"))


@query(ALERTS + " SELECT typology, count(*) AS n, round(CAST(max(confidence) AS DOUBLE), 6) AS max_confidence FROM al GROUP BY typology")
def alert_counts(spark, d):
    return rounded(all_alerts(spark, d).groupBy("typology").agg(F.count("*").alias("n"), F.max("confidence").alias("max_confidence")))


# ---- text

CLAIM_SQL = """cl AS (SELECT doc_id, CAST(doc_id % n.n AS VARCHAR) account_id, unnest(list_filter([CASE WHEN regexp_matches(lower(text), 'licen[sc]e|copyright') THEN 'cross_border_activity' END, CASE WHEN regexp_matches(lower(text), 'secret|password|token') THEN 'high_volume' END,
       CASE WHEN regexp_matches(lower(text), '@') THEN 'rapid_movement' END], lambda x: x IS NOT NULL)) claim_type FROM documents, n)"""


def reports(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("narrative"))
    n = int(table(spark, d, "events").agg(F.max("user_id")).first()[0]) + 1
    return docs.withColumn("account_id", (F.col("report_id") % n).cast("string"))


@query(CLAIM_SQL + " SELECT doc_id AS report_id, account_id, claim_type FROM cl")
def claim_extraction(spark, d):
    return text.extract_claims(reports(spark, d), PROSE_CLAIMS).drop("narrative")


VERDICT = FLOW + "," + MOTIF + "," + CLAIM_SQL + """, cr AS (SELECT CAST(src AS BIGINT) % 7 c, avg(cb) r FROM e GROUP BY 1),
vd AS (SELECT cl.doc_id, cl.account_id, claim_type, CASE WHEN cf.account_id IS NULL THEN 'NOT_FOUND' WHEN claim_type = 'cross_border_activity' THEN CASE WHEN r > 0.2 THEN 'CONFIRMED' ELSE 'REFUTED' END
  WHEN claim_type = 'high_volume' THEN CASE WHEN vin + vout > 7000 THEN 'CONFIRMED' ELSE 'REFUTED' END ELSE CASE WHEN hi > 0.3 OR coalesce(cyc, 0) > 0 THEN 'CONFIRMED' ELSE 'REFUTED' END END s
  FROM cl LEFT JOIN cf ON cf.account_id = cl.account_id LEFT JOIN mt ON mt.k = cl.account_id LEFT JOIN cr ON cr.c = CAST(cl.account_id AS BIGINT) % 7)"""


def verdicts(spark, d) -> DataFrame:
    e, c = ev(spark, d), communities(acc(spark, d))
    f = core(spark, d).join(graph.motif_triangles_cycles(e), "account_id", "left").join(c, "account_id").join(graph.community_cb_ratio(e, c), "community_id", "left")
    return text.verify_claims(text.extract_claims(reports(spark, d), PROSE_CLAIMS), f, cb_ratio=0.2, volume=7000.0)


@query(VERDICT + " SELECT doc_id AS report_id, account_id, claim_type, s AS verification_status FROM vd")
def claim_verdicts(spark, d):
    return verdicts(spark, d)


@query(VERDICT + """ SELECT doc_id AS report_id, account_id, CASE WHEN claim_type = 'cross_border_activity' THEN 'Cross-border transfers' WHEN claim_type = 'rapid_movement' THEN 'Speed of movement' ELSE 'Claim: ' || claim_type END AS text,
    CASE WHEN s = 'CONFIRMED' THEN 'The transaction network bears the claim out.' ELSE 'The transaction network doesn''t bear the claim out.' END AS details, s AS status FROM vd""")
def claim_texts(spark, d):
    return text.claim_texts(verdicts(spark, d))


def letters_sql(c: str) -> str:
    """Soundex in DuckDB: codes of the letters, H and W skipped, vowels kept as breaks, equal neighbours once."""
    codes = f"list_transform(string_split(regexp_replace(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), '(.)[HW]+', '\\1', 'g'), ''), lambda x: CASE WHEN x IN ('B','F','P','V') THEN '1' WHEN x IN ('C','G','J','K','Q','S','X','Z') THEN '2' WHEN x IN ('D','T') THEN '3' WHEN x = 'L' THEN '4' WHEN x IN ('M','N') THEN '5' WHEN x = 'R' THEN '6' ELSE '0' END)"
    tail = f"array_to_string(list_filter(list_transform(range(2, len({codes}) + 1), lambda i: CASE WHEN ({codes})[i] = ({codes})[i - 1] OR ({codes})[i] = '0' THEN '' ELSE ({codes})[i] END), lambda x: x <> ''), '')"
    return f"CASE WHEN regexp_replace(upper({c}), '[^A-Z]', '', 'g') = '' THEN '' ELSE substr(regexp_replace(upper({c}), '[^A-Z]', '', 'g')[1] || {tail} || '000', 1, 4) END"


@query(f"""w AS (SELECT p_partkey, split_part(p_name, ' ', 1) f, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', -1) ELSE '' END l FROM part)
SELECT p_partkey AS id, f AS first_name, l AS last_name, {letters_sql('f')} AS phonetic_first, {letters_sql('l')} AS phonetic_last FROM w""", "")
def phonetic_codes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return text.phonetic_columns(p).select("id", "first_name", "last_name", "phonetic_first", "phonetic_last")


def str_entities(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    tax = F.expr("case when p_partkey % 3 = 0 then cast(p_partkey * 37 as string) else '' end")
    return p.select(F.col("p_partkey").cast("string").alias("report_id"), words[0].alias("first_name"), F.element_at(words, -1).alias("last_name"), tax.alias("tax_number"), F.lit("").alias("narrative"))


LINK = f"""w AS (SELECT account_id, name, tax_number tax, split_part(name, ' ', 1) f, CASE WHEN contains(name, ' ') THEN split_part(name, ' ', -1) ELSE '' END l FROM a),
ac AS (SELECT *, {letters_sql('f')} pf, {letters_sql('l')} pl FROM w), bt AS (SELECT tax, min(account_id) account_id FROM ac WHERE tax <> '' GROUP BY tax),
en AS (SELECT CAST(p_partkey AS VARCHAR) rid, split_part(p_name, ' ', 1) f, split_part(p_name, ' ', -1) l, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey * 37 AS VARCHAR) ELSE '' END tax FROM part),
ep AS (SELECT *, {letters_sql('f')} pf, {letters_sql('l')} pl FROM en)
SELECT rid AS report_id, bt.account_id, 'direct' AS match_method FROM en JOIN bt ON bt.tax = en.tax AND en.tax <> ''
UNION ALL SELECT rid, ac.account_id, 'phonetic_fuzzy' FROM ep JOIN ac ON ac.pf = ep.pf AND ac.pl = ep.pl AND ep.pf <> '' AND ep.pl <> '' WHERE ep.tax NOT IN (SELECT tax FROM bt)"""


@query(LINK)
def link_cascade(spark, d):
    return text.link_entities(str_entities(spark, d), acc(spark, d)).select("report_id", "account_id", "match_method")


#: Longest common subsequence by bits: the zeros left after every letter of x has passed over the places of y (62 letters at most).
CONFIDENCE = LINK[: LINK.index("SELECT rid AS report_id, bt")].rstrip() + """,
near AS (SELECT rid, ac.account_id, ep.f || ' ' || ep.l ent, ac.name FROM ep JOIN ac ON ac.pf = ep.pf AND ac.pl = ep.pl AND ep.pf <> '' AND ep.pl <> '' WHERE ep.tax NOT IN (SELECT tax FROM bt)),
uq AS (SELECT DISTINCT lower(ent) x, lower(name) y FROM near),
ls AS (SELECT x, y, 0 i, (1::BIGINT << length(y)) - 1 v FROM uq UNION ALL
  SELECT x, y, i + 1, ((v + m) | (v - m)) & ((1::BIGINT << length(y)) - 1) FROM (
    SELECT x, y, i, v, v & CAST(list_sum(list_transform(range(1, length(y) + 1), lambda j: CASE WHEN substr(y, j, 1) = substr(x, i + 1, 1) THEN 1::BIGINT << (j - 1) ELSE 0 END)) AS BIGINT) m FROM ls WHERE i < length(x))),
sim AS (SELECT x, y, 2.0::DOUBLE * (length(y) - bit_count(v)) / (length(x) + length(y)) r FROM ls WHERE i = length(x))
SELECT rid AS report_id, f || ' ' || l AS str_entity, bt.account_id, 'direct' AS match_method, CAST(1 AS DOUBLE) AS confidence FROM en JOIN bt ON bt.tax = en.tax AND en.tax <> ''
UNION ALL SELECT rid, ent, account_id, 'phonetic_fuzzy', round_even(0.6::DOUBLE + 0.38::DOUBLE * r, 3) FROM near JOIN sim ON x = lower(ent) AND y = lower(name)"""


@query(CONFIDENCE)
def link_confidence(spark, d):
    return text.link_entities(str_entities(spark, d), acc(spark, d)).drop("narrative")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS report_id, split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', -1) AS last_name, CAST(p_partkey * 37 AS VARCHAR) AS tax_number, 'Movement of ' || p_type AS narrative FROM part""", "")
def xml_entities(spark, d):
    x = table(spark, d, "part").select(F.expr("""concat('<report><report_id>', p_partkey, '</report_id><reason>Movement of ', p_type, '</reason><transaction><t_from_my_client><from_account><signatory><t_person><first_name>', split(p_name, ' ')[0],
        '</first_name><last_name>', element_at(split(p_name, ' '), -1), '</last_name><tax_number>', p_partkey * 37, '</tax_number></t_person></signatory></from_account></t_from_my_client></transaction></report>')""").alias("x"))
    return ledger.entities(x.select(F.from_xml("x", ledger.REPORT.simpleString()).alias("r"))).select("report_id", "first_name", "last_name", "tax_number", "narrative")


def report_xml(spark, d) -> DataFrame:
    """A report for each part: names in CDATA, a comment with a person who isn't there, people at two depths."""
    person = "concat('<t_person><first_name><![CDATA[', split(p_name, ' ')[0], ']]></first_name><last_name>', element_at(split(p_name, ' '), -1), '</last_name><tax_number>', p_partkey * 37, '</tax_number></t_person>')"
    return table(spark, d, "part").select(F.expr(f"""concat('<report><report_id>', p_partkey, '</report_id><!-- <t_person><first_name>Nobody</first_name></t_person> --><reason>Movement of ', p_type, '</reason><body>',
        case when p_partkey % 2 = 0 then concat('<deep>', {person}, '</deep>') else {person} end, '</body></report>')""").alias("x"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS report_id, split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', -1) AS last_name, CAST(p_partkey * 37 AS VARCHAR) AS tax_number, 'Movement of ' || p_type AS narrative FROM part""", "")
def xml_files(spark, d):
    """Reports written to files, several a file, and read back."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    report_xml(spark, d).write.text(path)
    return ledger.read_reports(spark, path, "*.txt").select("report_id", "first_name", "last_name", "tax_number", "narrative")


# ---- risk

SCORE = FLOW + """, hs AS (SELECT account_id, least(greatest(0.4 * (vin + vout) / (SELECT max(vin + vout) FROM cf), 0), 1) s FROM cf),
rk AS (SELECT account_id, s, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / count(*) OVER () * 100 pct, row_number() OVER (ORDER BY s DESC, account_id) rn,
  CASE WHEN s <= 0.25 THEN 'LOW' WHEN s <= 0.5 THEN 'ELEVATED' WHEN s <= 0.75 THEN 'HIGH' WHEN s <= 0.9 THEN 'SEVERE' ELSE 'CRITICAL' END band FROM hs)"""


@query(SCORE + " SELECT account_id, round(s, 6) AS risk_score FROM hs")
def heuristic_score(spark, d):
    return rounded(risk.heuristic_score(core(spark, d)))


@query(SCORE + " SELECT account_id, round(s, 6) AS risk_score, round(pct, 6) AS risk_percentile, band AS risk_band, rn AS rank FROM rk")
def risk_percentile(spark, d):
    return rounded(risk.rank_scores(risk.heuristic_score(core(spark, d))))


@query(SCORE + " SELECT band AS risk_band, count(*) AS n FROM rk GROUP BY band")
def risk_bands(spark, d):
    return risk.heuristic_score(core(spark, d)).groupBy(risk_band(F.col("risk_score")).alias("risk_band")).agg(F.count("*").alias("n"))


@query(SCORE + """ SELECT rn AS rank, rk.account_id, round(s, 6) AS risk_score, band AS risk_band, round(fr, 6) AS flow_ratio, round(dfa, 6) AS dfa_score, round(hi, 6) AS hawkes_intensity, round(tps, 6) AS tps_score
    FROM rk JOIN cf ON cf.account_id = rk.account_id ORDER BY rn LIMIT 250""")
def high_risk_queue(spark, d):
    f = graph.cut(core(spark, d))
    top = risk.rank_scores(risk.heuristic_score(f)).orderBy("rank").limit(250)
    return rounded(top.join(f, "account_id").select("rank", "account_id", "risk_score", "risk_band", "flow_ratio", "dfa_score", "hawkes_intensity", "tps_score"))


def dempster_sql(name: str, source: str, a: str, b: str) -> str:
    s, n, t = f"({a}s*{b}s+{a}s*{b}t+{a}t*{b}s)", f"({a}n*{b}n+{a}n*{b}t+{a}t*{b}n)", f"({a}t*{b}t)"
    k = f"({a}s*{b}n+{a}n*{b}s)"
    tot = f"({s}+{n}+{t})"
    return (f"{name} AS (SELECT *, CASE WHEN {k} >= 0.999 THEN greatest({a}s,{b}s) WHEN {tot} = 0 THEN 0 ELSE {s}/{tot} END {name}s, CASE WHEN {k} >= 0.999 THEN least({a}n,{b}n) WHEN {tot} = 0 THEN 1 ELSE {n}/{tot} END {name}n, "
            f"CASE WHEN {k} >= 0.999 OR {tot} = 0 THEN 0 ELSE {t}/{tot} END {name}t FROM {source})")


FUSE = (SCORE + "," + VERDICT.removeprefix(FLOW + ",") + "," + ALERTS.removeprefix(FLOW + ",") + """,
ta AS (SELECT account_id, max(confidence) tp FROM al GROUP BY 1), sa AS (SELECT account_id, CASE max(CASE s WHEN 'CONFIRMED' THEN 3 WHEN 'REFUTED' THEN 2 ELSE 1 END) WHEN 3 THEN 0.95 WHEN 2 THEN 0.1 ELSE 0.4 END sp FROM vd GROUP BY 1),
m0 AS (SELECT cf.account_id, hs.s p, least(hi / 5, 1.0) g, CAST(coalesce(tp, 0) AS DOUBLE) tp, CAST(coalesce(sp, 0) AS DOUBLE) sp FROM cf JOIN hs USING (account_id) LEFT JOIN ta USING (account_id) LEFT JOIN sa USING (account_id)),
m1 AS (SELECT *, 0.8::DOUBLE*p as_, 0.8::DOUBLE*(1-p) an, 0.2::DOUBLE at_, 0.7::DOUBLE*g bs, 0.7::DOUBLE*(1-g) bn, 0.3::DOUBLE bt_, 0.9::DOUBLE*tp cs, 0.0::DOUBLE cn, 1-0.9::DOUBLE*tp ct, sp ds, 0.0::DOUBLE dn, 1-sp dt_ FROM m0),
m2 AS (SELECT *, as_ xs, an xn, at_ xt, bs ys, bn yn, bt_ yt, cs zs, cn zn, ct zt, ds qs, dn qn, dt_ qt FROM m1),""" + dempster_sql("u", "m2", "x", "y") + "," + dempster_sql("v", "u", "u", "z") + "," + dempster_sql("fz", "v", "v", "q"))


def fused(spark, d) -> DataFrame:
    f = graph.cut(core(spark, d))
    return graph.cut(risk.fuse(risk.heuristic_score(f), f, all_alerts(spark, d), verdicts(spark, d)))


@query(FUSE + " SELECT account_id, round(p, 6) AS risk_score, round(fzs, 6) AS belief, round(fzs + fzt, 6) AS plausibility FROM fz")
def dempster_fuse(spark, d):
    return rounded(fused(spark, d))


def contagion_sql(k: int) -> str:
    steps = [f"r{i + 1} AS (SELECT f0.k, least(f0.f + 0.35 * coalesce(x, 0), 1.0) r FROM f0 LEFT JOIN (SELECT dst k, sum(w * r) x FROM wt JOIN r{i} ON r{i}.k = wt.src GROUP BY dst) q ON q.k = f0.k)" for i in range(k)]
    return ("ti AS (SELECT dst, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) ti, max(us) tr FROM e GROUP BY dst), wt AS (SELECT src, e.dst, sum(amount / (ti + 1e-9) * exp(-0.05 * greatest(0, (tr - us) / 3.6e9))) w FROM e JOIN ti ON ti.dst = e.dst GROUP BY ALL), "
            "r0 AS (SELECT k, f r FROM f0), " + ", ".join(steps))


@query(SCORE + ", f0 AS (SELECT account_id k, s f FROM hs), " + contagion_sql(5) + " SELECT k AS account_id, round(f0.f, 6) AS base, round(r, 6) AS risk FROM r5 JOIN f0 USING (k)")
def contagion_5(spark, d):
    return rounded(risk.contagion(risk.heuristic_score(core(spark, d)), ev(spark, d), score="risk_score"))


@query(FUSE + ", f0 AS (SELECT account_id k, fzs f FROM fz), " + contagion_sql(5) + """, rs AS (SELECT k, round(r, 6) s, round(f, 6) f FROM r5 JOIN f0 USING (k))
SELECT row_number() OVER (ORDER BY s DESC, k) AS rank, k AS account_id, s AS risk_score, f AS risk_score_fused, round(round((rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / count(*) OVER () * 100, 6), 6) AS risk_percentile,
  CASE WHEN s <= 0.25 THEN 'LOW' WHEN s <= 0.5 THEN 'ELEVATED' WHEN s <= 0.75 THEN 'HIGH' WHEN s <= 0.9 THEN 'SEVERE' ELSE 'CRITICAL' END AS risk_band FROM rs""")
def risk_scores(spark, d):
    r = risk.contagion(fused(spark, d), ev(spark, d)).select("account_id", F.round("risk", 6).alias("risk_score"), F.round("base", 6).alias("risk_score_fused"))
    return rounded(risk.rank_scores(r)).select("rank", "account_id", "risk_score", "risk_score_fused", "risk_percentile", "risk_band")


SHAP_W = {"in_volume": 0.002, "out_volume": 0.001, "tps_score": 1.5, "hawkes_intensity": 2.0, "in_degree": -0.01}
SHAP_SQL = FLOW + ", mn AS (SELECT CAST(sum(CAST(vin AS DECIMAL(28,6))) AS DOUBLE)/count(*) a, CAST(sum(CAST(vout AS DECIMAL(28,6))) AS DOUBLE)/count(*) b, CAST(sum(CAST(tps AS DECIMAL(28,6))) AS DOUBLE)/count(*) c, CAST(sum(CAST(hi AS DECIMAL(28,6))) AS DOUBLE)/count(*) d, CAST(sum(CAST(din AS DECIMAL(28,6))) AS DOUBLE)/count(*) f FROM cf), sh AS (" + " UNION ALL ".join(
    f"SELECT account_id, '{n}' feature, {w} * ({c} - {m}) v FROM cf, mn" for (n, w), c, m in zip(SHAP_W.items(), ("vin", "vout", "tps", "hi", "din"), "abcdf")
) + ")"


def linear_shap_rows(spark, d) -> DataFrame:
    return learn.linear_shap(core(spark, d), SHAP_W)


@query(SHAP_SQL + " SELECT account_id, feature, round(v, 5) AS shap_value, round(abs(v), 5) AS abs_shap_value FROM sh")
def linear_shap(spark, d):
    return rounded(linear_shap_rows(spark, d), 5)


@query(SHAP_SQL + f" SELECT account_id, feature, round(v, 5) AS shap_value, round(abs(v), 5) AS abs_shap_value FROM sh WHERE account_id = '{ACCOUNT}' ORDER BY abs(v) DESC, feature LIMIT 15")
def serve_shap(spark, d):
    return rounded(serve.account_shap(linear_shap_rows(spark, d), ACCOUNT), 5)


@query(SHAP_SQL + """, gr AS (SELECT account_id, CASE WHEN regexp_matches(feature, 'sent_|sender_|tx_count|velocity|amount|threshold|tps|dfa|hawkes') THEN 'self_behavior' WHEN regexp_matches(feature, 'received_|receiver_|counterparty|neighbor|degree') THEN 'counterparty' ELSE 'self_behavior' END g, abs(v) v FROM sh),
gs AS (SELECT u.account_id, n.g, coalesce((SELECT sum(v) FROM gr WHERE gr.account_id = u.account_id AND gr.g = n.g), 0) s FROM (SELECT DISTINCT account_id FROM sh) u, (SELECT unnest(['self_behavior', 'counterparty', 'community', 'external']) g) n)
SELECT account_id, g AS driver_group, round(s / sum(s) OVER (PARTITION BY account_id), 6) AS share FROM gs""")
def driver_shares(spark, d):
    return rounded(risk.driver_shares(linear_shap_rows(spark, d)))


@query(f"SELECT tx_id, src, dst, amount, round(amount / CAST(sum(CAST(amount AS DECIMAL(28,6))) OVER () AS DOUBLE) * 0.6, 6) AS risk_drop FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}' ORDER BY 5 DESC, 1 LIMIT 25")
def counterfactual_edges(spark, d):
    return risk.counterfactual_edges(ev(spark, d), ACCOUNT)


@query(SCORE + "," + ALERTS.removeprefix(FLOW + ",") + "," + VERDICT.removeprefix(FLOW + ",") + """ SELECT coalesce((SELECT string_agg(claim_type || '=' || s, ',' ORDER BY claim_type) FROM (SELECT claim_type, max(s) s FROM vd WHERE vd.account_id = rk.account_id GROUP BY claim_type)), '') AS claims, rk.account_id, round(s, 6) AS risk_score, band AS risk_band, rn AS rank, round(vin, 6) AS in_volume, round(vout, 6) AS out_volume, coalesce((SELECT string_agg(DISTINCT typology, ',' ORDER BY typology) FROM al WHERE al.account_id = rk.account_id), '') AS typologies
    FROM rk JOIN cf USING (account_id)""")
def case_record(spark, d):
    f = graph.cut(core(spark, d))
    c = risk.case_records(risk.rank_scores(risk.heuristic_score(f)), f, all_alerts(spark, d), verdicts(spark, d))
    said = F.array_join(F.expr("transform(map_entries(claims), x -> concat(x.key, '=', x.value))"), ",")
    return rounded(c.withColumn("claims", said).withColumn("typologies", F.array_join("typologies", ",")))


REPORT = SCORE + "," + ALERTS.removeprefix(FLOW + ",") + "," + VERDICT.removeprefix(FLOW + ",") + """,
ty AS (SELECT account_id, string_agg(DISTINCT typology, ', ' ORDER BY typology) t FROM al GROUP BY 1),
cs AS (SELECT account_id, string_agg('- ' || claim_type || ': ' || s, chr(10) ORDER BY claim_type) t FROM (SELECT account_id, claim_type, max(s) s FROM vd GROUP BY ALL) GROUP BY 1)
SELECT rk.account_id, printf('Case file of account %s', rk.account_id) || chr(10) || printf('Risk %s, score %.3f, rank %d', band, s, rn) || chr(10) || chr(10) || '1. Summary' || chr(10) || format('Inbound {:,.2f}, outbound {:,.2f}', vin, vout)
  || printf(', ratio %.2f', vout / (vin + 1e-5)) || chr(10) || chr(10) || '2. Typologies' || chr(10) || coalesce(ty.t, 'none') || chr(10) || chr(10) || '3. Claims' || chr(10) || coalesce(cs.t, '- none')
  || chr(10) || chr(10) || '4. Recommendation' || chr(10) || 'Review and decide on filing.' AS report
FROM rk JOIN cf ON cf.account_id = rk.account_id LEFT JOIN ty ON ty.account_id = rk.account_id LEFT JOIN cs ON cs.account_id = rk.account_id"""


@query(REPORT)
def case_report(spark, d):
    f = graph.cut(core(spark, d))
    return text.case_report(risk.case_records(risk.rank_scores(risk.heuristic_score(f)), f, all_alerts(spark, d), verdicts(spark, d)))


# ---- an analyst's questions about one account, and the queue


MINE = f"mine AS (SELECT * FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}')"


@query(MINE + " SELECT tx_id, src, dst, amount, us, cb FROM mine ORDER BY us, tx_id LIMIT 2500")
def point_transactions(spark, d):
    return LedgerIndex.build(ev(spark, d)).transactions(ACCOUNT)


@query(MINE + f""", t AS (SELECT * FROM mine ORDER BY us, tx_id LIMIT 100), h0 AS (SELECT 0 hop, '{ACCOUNT}' k, amount FROM t ORDER BY us, tx_id LIMIT 1),
h1 AS (SELECT 1 hop, dst k, amount FROM t WHERE src = '{ACCOUNT}' ORDER BY amount DESC, us, tx_id LIMIT 1), h2 AS (SELECT 2 hop, dst k, amount FROM t WHERE src IN (SELECT k FROM h1) ORDER BY amount DESC, us, tx_id LIMIT 1)
SELECT CAST(hop AS INTEGER) AS hop, k AS account_id, CAST(trunc(amount) AS BIGINT) AS amount FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)""")
def point_path(spark, d):
    return LedgerIndex.build(ev(spark, d)).path(ACCOUNT)


@query(SUB.replace("SELECT src, dst, us, amount, CASE", ", li AS (SELECT src, dst, us, amount, CASE", 1) + """),
ro AS (SELECT src id, role_source role FROM li UNION SELECT dst, role_target FROM li)
SELECT id, coalesce(name, 'Unknown Entity') AS name, coalesce(institution, 'N/A') AS bank, role FROM ro LEFT JOIN a ON a.account_id = id""")
def point_subgraph_nodes(spark, d):
    return LedgerIndex.build(ev(spark, d)).subgraph(ACCOUNT, acc(spark, d))[0]


@query(SUB.replace("SELECT src, dst, us, amount, CASE", ", li AS (SELECT src, dst, us, amount, CASE", 1) + ") SELECT src AS source, dst AS target, amount, us FROM li")
def point_subgraph_links(spark, d):
    return LedgerIndex.build(ev(spark, d)).subgraph(ACCOUNT, acc(spark, d))[1]


@query(f"""f1 AS (SELECT '{ACCOUNT}' k UNION SELECT dst FROM e WHERE src = '{ACCOUNT}' UNION SELECT src FROM e WHERE dst = '{ACCOUNT}'),
f2 AS (SELECT k FROM f1 UNION SELECT dst FROM e WHERE src IN (SELECT k FROM f1) UNION SELECT src FROM e WHERE dst IN (SELECT k FROM f1))
SELECT tx_id, src, dst, amount, us, cb FROM e WHERE src IN (SELECT k FROM f2) AND dst IN (SELECT k FROM f2)""")
def point_within(spark, d):
    return LedgerIndex.build(ev(spark, d)).within(ACCOUNT)


@query(FLOW + f""" SELECT account_id, acct_type, round(vin, 6) AS in_volume, round(vout, 6) AS out_volume, din AS in_degree, dout AS out_degree, round(fr, 6) AS flow_ratio, round(dfa, 6) AS dfa_score,
       round(hi, 6) AS hawkes_intensity, round(tps, 6) AS tps_score, br AS band_recipients FROM cf WHERE account_id = '{ACCOUNT}'""")
def serve_features(spark, d):
    return rounded(serve.account_features(core(spark, d), ACCOUNT))


@query(VERDICT + f""" SELECT doc_id AS report_id, account_id, CASE WHEN claim_type = 'cross_border_activity' THEN 'Cross-border transfers' WHEN claim_type = 'rapid_movement' THEN 'Speed of movement' ELSE 'Claim: ' || claim_type END AS text,
    CASE WHEN s = 'CONFIRMED' THEN 'The transaction network bears the claim out.' ELSE 'The transaction network doesn''t bear the claim out.' END AS details, s AS status FROM vd WHERE account_id = '{CLAIMANT}'""")
def serve_claims(spark, d):
    return serve.account_claims(verdicts(spark, d), CLAIMANT)


@query(ALERTS + " SELECT account_id, typology, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM al ORDER BY CAST(confidence AS DOUBLE) DESC, account_id, typology LIMIT 500")
def serve_alerts(spark, d):
    return rounded(serve.alerts(all_alerts(spark, d)).drop("details"))


@query(SCORE + " SELECT count(*) AS accounts, count(*) FILTER (band = 'CRITICAL') AS critical, round(max(s), 6) AS max_score FROM rk")
def serve_overview(spark, d):
    return rounded(serve.overview(serve.loaded_scores(risk.heuristic_score(core(spark, d)))))


@query(SCORE + " SELECT account_id, round(s, 6) AS risk_score, round(pct, 6) AS risk_percentile, band AS risk_band, rn AS rank FROM rk WHERE s >= 0.3 AND band IN ('ELEVATED', 'HIGH')")
def serve_queue(spark, d):
    return rounded(serve.filtered_queue(serve.loaded_scores(risk.heuristic_score(core(spark, d))), 0.3, ("ELEVATED", "HIGH")))


# ---- learning

TXA = f"""ag AS (SELECT k, """ + ", ".join(
    f"coalesce(CAST(sum(CAST({c} AS DECIMAL(28,6))) FILTER (out = {o}) AS DOUBLE), 0) {s}_{c}_sum, coalesce(CAST(sum(CAST({c} AS DECIMAL(28,6))) FILTER (out = {o}) AS DOUBLE) / nullif(count({c}) FILTER (out = {o}), 0), 0) {s}_{c}_mean, coalesce(CAST(max({c}) FILTER (out = {o}) AS DOUBLE), 0) {s}_{c}_max, coalesce(stddev_samp({c}) FILTER (out = {o}), 0) {s}_{c}_std"
    for o, s in ((1, "sent"), (0, "received")) for c in ("amount", "cb")
) + ", CAST(count(*) FILTER (out = 1) AS BIGINT) sent_tx_count, CAST(count(*) FILTER (out = 0) AS BIGINT) received_tx_count FROM b GROUP BY k)"
TX_COLUMNS = [f"{s}_{c}_{t}" for s in ("sent", "received") for c, ts in (("amount", ("sum", "mean", "max", "std")), ("cb", ("mean", "max"))) for t in ts]


@query(FLOW + "," + TXA + " SELECT k AS account_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in TX_COLUMNS) + """, sent_tx_count, received_tx_count, round(received_amount_sum - sent_amount_sum, 6) AS net_flow,
    round(coalesce(received_amount_sum / nullif(received_amount_sum + sent_amount_sum, 0), 0), 6) AS inbound_flow_ratio FROM ag""")
def tx_to_account(spark, d):
    return rounded(learn.account_table(ev(spark, d)))


@query("SELECT account_id, CAST(coalesce((SELECT max(CAST(amount > 99 AS INTEGER)) FROM e WHERE e.src = a.account_id), 0) AS INTEGER) AS is_suspicious FROM a")
def label_attach(spark, d):
    labels = ev(spark, d).select(F.col("src").alias("account"), (F.col("amount") > 99).cast("int").alias("label"))
    return learn.attach_labels(acc(spark, d).select("account_id"), labels)


@query("""s AS (SELECT round(value) s, CAST(event_type = 'error' AS INTEGER) y FROM events), p AS (SELECT s, sum(y) p, count(*) n FROM s GROUP BY s),
c AS (SELECT s, p, sum(p) OVER w tp, sum(n) OVER w k, sum(p) OVER () tot, sum(n) OVER () al FROM p WINDOW w AS (ORDER BY s DESC)), f AS (SELECT *, coalesce(2 * (tp / k) * (tp / tot) / nullif(tp / k + tp / tot, 0), 0) f1 FROM c)
SELECT round(sum(p / tot * (tp / k)), 6) AS average_precision, round(max(tot) / max(al), 6) AS base_rate, round(max(f1), 6) AS best_f1, arg_max(s, {'a': f1, 'b': -s}) AS best_threshold FROM f""", "")
def pr_metrics(spark, d):
    s = table(spark, d, "events").select(F.round("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return rounded(learn.pr_metrics(s))


def labelled(spark, d) -> DataFrame:
    f = core(spark, d)
    mean = f.agg(F.avg("out_volume").alias("mean"))
    y = f.join(F.broadcast(mean)).select("account_id", (F.col("out_volume") > F.col("mean")).cast("int").alias("label"))
    return graph.cut(learn.attach_labels(f, y))


#: Trees of the registered models.
TREES = 350


@query()
def gbt_scores(spark, d):
    return learn.train_and_score(labelled(spark, d), trees=TREES)[0]


@query()
def shap_long(spark, d):
    data = labelled(spark, d)
    _, model, cols = learn.train_and_score(data, trees=TREES)
    return learn.tree_shap(model, learn.model_input(data, cols))


@query("""SELECT src AS account_id, round(CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE), 6) AS volume FROM e GROUP BY src ORDER BY 2 DESC, 1 LIMIT 15""")
def top_senders(spark, d):
    return rounded(ev(spark, d).groupBy(F.col("src").alias("account_id")).agg(flow.money_sum("amount").alias("volume"))).orderBy(F.desc("volume"), "account_id").limit(15)


CENSUS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing FROM events" for c in CENSUS), "")
def missing_census(spark, d):
    t = table(spark, d, "events")
    one = t.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in CENSUS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col("n").alias("rows"), F.col(c).alias("missing")) for c in CENSUS])).alias("x")).select("x.*")


CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query("y AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) y FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS correlation FROM y" for c in CORR), "")
def label_correlation(spark, d):
    t = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return rounded(learn.label_correlations(t, list(CORR), "y"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(CORR) for b in CORR[i:]), "")
def correlation_matrix(spark, d):
    return rounded(learn.correlation_matrix(table(spark, d, "lineitem"), list(CORR)))


@query(f"SELECT tx_id, src, dst, amount, us, cb FROM e WHERE src = '{ACCOUNT}' OR dst = '{ACCOUNT}' ORDER BY us, tx_id LIMIT 80")
def ego_edges(spark, d):
    return graph.ego_edges(ev(spark, d), ACCOUNT).select("tx_id", "src", "dst", "amount", "us", "cb")


RELATIONS = """r AS (SELECT 'SENDS' relation, src source, dst target FROM e UNION ALL SELECT 'OWNS', CASE WHEN name <> '' THEN 'cust_' || replace(name, ' ', '_') ELSE 'cust_' || account_id END, account_id FROM a
  UNION ALL SELECT 'LOCATED_IN', account_id, branch FROM a UNION ALL SELECT 'LOCATED_IN', branch, institution FROM a UNION ALL SELECT 'LOCATED_IN', institution, 'NP' FROM a)"""


@query(RELATIONS + f""", f1 AS (SELECT '{ACCOUNT}' k UNION SELECT target FROM r WHERE source = '{ACCOUNT}' UNION SELECT source FROM r WHERE target = '{ACCOUNT}'),
f2 AS (SELECT k FROM f1 UNION SELECT target FROM r WHERE source IN (SELECT k FROM f1) UNION SELECT source FROM r WHERE target IN (SELECT k FROM f1))
SELECT relation, source, target, count(*) AS n FROM r WHERE source IN (SELECT k FROM f2) AND target IN (SELECT k FROM f2) GROUP BY ALL""")
def evidence_subgraph(spark, d):
    return graph.evidence_subgraph(acc(spark, d), ev(spark, d), ACCOUNT).groupBy("relation", "source", "target").agg(F.count("*").alias("n"))


@query()
def leiden(spark, d):
    return graph.leiden(ev(spark, d), acc(spark, d))


@query()
def label_propagation(spark, d):
    return graph.label_propagation(ev(spark, d), acc(spark, d))


def ranked_features(spark, d) -> DataFrame:
    return graph.cut(core(spark, d).join(graph.pagerank(ev(spark, d)), "account_id", "left").na.fill(0.0))


def weight_sql(i, j, seed: float) -> str:
    return f"sin(12.9898::DOUBLE * {i} + 78.233::DOUBLE * {j} + {seed}::DOUBLE)"


def projected_sql(columns: tuple[str, ...], j: str, seed: float) -> str:
    return "(" + " + ".join(f"{c} * {weight_sql(i, j, seed)}" for i, c in enumerate(columns)) + ") * 0.5::DOUBLE"


def wide_sql(prefix: str, dim: int = 16) -> str:
    return ", ".join(f"round(max(v) FILTER (j = {i}), 6) AS emb_{prefix}_{i}" for i in range(dim))


HAN = FLOW + "," + PR + f""", hx AS (SELECT cf.account_id, CASE WHEN name <> '' THEN name ELSE cf.account_id END cu, branch, fr, tps, coalesce(x, 0)::DOUBLE pr, hi FROM cf JOIN a ON a.account_id = cf.account_id LEFT JOIN x10 ON x10.k = cf.account_id),
hh AS (SELECT account_id, cu, branch, j, {projected_sql(('fr', 'tps', 'pr', 'hi'), 'j', 1.0)} h FROM hx, (SELECT unnest(range(16)) j)),
hz AS (SELECT account_id, j, avg(h) OVER (PARTITION BY cu, j) zc, avg(h) OVER (PARTITION BY branch, j) zb FROM hh),
he AS (SELECT sum(tanh(zc) * {weight_sql(0, 'j', 7.0)}) / count(DISTINCT account_id) ec, sum(tanh(zb) * {weight_sql(0, 'j', 7.0)}) / count(DISTINCT account_id) eb FROM hz),
hv AS (SELECT account_id, j, (exp(ec) * zc + exp(eb) * zb) / (exp(ec) + exp(eb)) v FROM hz, he)
SELECT account_id, {wide_sql('han')} FROM hv GROUP BY account_id"""


@query(HAN)
def han_embedding(spark, d):
    return rounded(embed.wide(embed.han(acc(spark, d), ranked_features(spark, d)), "han"))


STANDARD = ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9::DOUBLE) {c}" for c in ("vin", "vout", "pr", "hi"))
TGAT = FLOW + "," + PR + f""", tx AS (SELECT account_id, {STANDARD} FROM (SELECT account_id, vin, vout, coalesce(x, 0)::DOUBLE pr, hi FROM cf LEFT JOIN x10 ON x10.k = account_id)),
th AS (SELECT account_id, j, {projected_sql(('vin', 'vout', 'pr', 'hi'), 'j', 2.0)} h FROM tx, (SELECT unnest(range(8)) j)),
tl AS (SELECT account_id, list(h ORDER BY j) h FROM th GROUP BY account_id),
te AS (SELECT b.k, b.o, (max(us) OVER (PARTITION BY b.k) - us) / 3.6e9::DOUBLE dh FROM b JOIN tl ON tl.account_id = b.o WHERE us IS NOT NULL),
tp2 AS (SELECT te.k, p.h hk, q.h g, list_transform(range(8), lambda i: cos(dh * pow(10000.0::DOUBLE, -2.0::DOUBLE * i / 16))) pc, list_transform(range(8), lambda i: sin(dh * pow(10000.0::DOUBLE, -2.0::DOUBLE * i / 16))) ps FROM te JOIN tl p ON p.account_id = te.k JOIN tl q ON q.account_id = te.o),
tn AS (SELECT k, list_concat(g, pc) v, list_sum(list_transform(range(8), lambda i: hk[i + 1] * g[i + 1] * {weight_sql('i', 'i', 3.0)}))
   + list_sum(list_transform(range(16), lambda i: (list_concat(pc, ps))[i + 1] * {weight_sql('i', 0, 4.0)} * 0.1::DOUBLE)) en FROM tp2),
tw AS (SELECT k, v, exp(en - max(en) OVER (PARTITION BY k)) w FROM tn), tj AS (SELECT k, w, unnest(v) x, unnest(range(16)) j FROM tw), ts AS (SELECT k, j, sum(w * x) / sum(w) v FROM tj GROUP BY ALL),
tv AS (SELECT account_id, n.j, CASE WHEN EXISTS (SELECT 1 FROM tw WHERE tw.k = account_id) THEN ts.v WHEN n.j < 8 THEN tl.h[n.j + 1] ELSE 0 END v FROM tl CROSS JOIN (SELECT unnest(range(16)) j) n LEFT JOIN ts ON ts.k = account_id AND ts.j = n.j)
SELECT account_id, {wide_sql('tgat')} FROM tv GROUP BY account_id"""


@query(TGAT)
def tgat_embedding(spark, d):
    return rounded(embed.wide(embed.tgat(ev(spark, d), ranked_features(spark, d)), "tgat"))


@query()
def netmf_embedding(spark, d):
    return embed.wide(embed.netmf(ev(spark, d), acc(spark, d)), "dw")


#: Queries whose columns make the whole feature matrix, with what stands for an account that one of them doesn't have.
WIDE = ("pagerank_k10", "burt_constraint", "scan_clusters", "betti_persistence", "motif_triangles_cycles", "motif_fans", "tgat_embedding", "han_embedding")
WIDE_COLUMNS = [
    "pagerank", "structural_constraint", "betti_birth", "betti_death", "betti_persistence", "motif_triangle", "motif_cycle", "motif_fanout", "motif_fanin",
    *[f"emb_{e}_{i}" for e in ("tgat", "han") for i in range(16)],
]


@query(
    f"SELECT f.*, scan_cluster, CAST(f.account_id AS BIGINT) % 7 AS community_id, coalesce(comm_cb_ratio, 0) AS comm_cb_ratio, {', '.join(f'coalesce({c}, 0) AS {c}' for c in WIDE_COLUMNS)} FROM ({ORACLES['feature_matrix']}) f "
    + " ".join(f"LEFT JOIN ({ORACLES[n]}) q{i} ON q{i}.account_id = f.account_id" for i, n in enumerate(WIDE))
    + f" LEFT JOIN ({ORACLES['community_cb_ratio']}) r ON r.community_id = CAST(f.account_id AS BIGINT) % 7",
    "",
)
def feature_matrix_wide(spark, d):
    """Every account with all features that have an SQL twin: flows, times, centrality, motifs, clusters, persistence, communities, embeddings."""
    out = feature_matrix(spark, d)
    for n in WIDE:
        out = out.join(QUERIES[n](spark, d), "account_id", "left")
    c = communities(acc(spark, d))
    ratio = rounded(graph.community_cb_ratio(ev(spark, d), c))
    return out.join(c, "account_id", "left").join(ratio, "community_id", "left").na.fill(0)
