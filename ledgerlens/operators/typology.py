"""Alert detectors. Each returns account_id, typology, confidence, details."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import money_sum
from ledgerlens.operators.flow import both_ends
from ledgerlens.operators.graph import HOUR, ahead_of, apart, cut, time_bucket


def alert(df: DataFrame, name: str, confidence, details) -> DataFrame:
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return df.select("account_id", F.lit(name).alias("typology"), conf.cast("double").alias("confidence"), details.alias("details"))


def layering(edges: DataFrame, features: DataFrame, *, window_hours: float = 72.0, min_nodes: int = 3, conservation: float = 0.97, max_nodes: int = 6, start_ratio: float = 0.97, start_volume: float = 200_000.0) -> DataFrame:
    """Ends of chains along which the amount is kept within the window; times that are null aren't checked. Hops count nodes.

    Hops meet on the account and on logarithmic buckets of the amount, as wide as an amount may change, so that a hub's edges are dealt by amount.
    """
    w, hi = int(window_hours * HOUR), 2 - conservation
    width = max(-math.log(conservation), math.log(hi), 1e-9) * 1.001
    e = edges.select("src", "dst", "amount", "us").join(features.select(F.col("account_id").alias("dst")), "dst", "left_semi")
    start = features.where((F.col("flow_ratio") >= start_ratio) & (F.col("out_volume") > start_volume)).select(F.col("account_id").alias("src"))
    bucket = lambda x: f"floor(ln(abs({x})) / {width})"
    e = e.withColumn("ab", F.expr(bucket("amount")))
    path = e.join(start, "src", "left_semi").where("src <> dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"), F.col("amount").alias("la"), F.col("us").alias("lu"))
    found = []
    for n in range(3, max_nodes + 1):
        near = path.withColumn("b", F.expr(bucket("la + 1e-9"))).select("*", F.explode(F.expr("array(b - 1, b, b + 1)")).alias("pb"))
        nxt = near.join(e, F.expr(f"last = src and pb = ab and not array_contains(path, dst) and coalesce(us between lu and lu + {w}, true) and amount / (la + 1e-9) between {conservation} and {hi}"))
        path = nxt.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"), F.col("amount").alias("la"), F.col("us").alias("lu"))
        if n >= min_nodes:
            found.append(path)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    ends = rows.groupBy(F.col("last").alias("account_id")).agg(F.min(F.array_join("path", " -> ")).alias("d"))
    return alert(ends, "Layering Chain", 0.95, F.col("d"))


def structuring(features: DataFrame, *, min_recipients: int = 3, min_share: float = 0.35) -> DataFrame:
    """Accounts that send to several receivers just below the threshold (features: tps_score, band_recipients)."""
    hit = features.where((F.col("band_recipients") >= min_recipients) & (F.col("tps_score") > min_share))
    return alert(hit, "Structuring Star", F.least(0.7 + 0.3 * F.col("tps_score"), F.lit(0.99)), F.format_string("%d receivers below the threshold", F.col("band_recipients").cast("int")))


def in_cycles(legs: DataFrame, w: int, rounds: int = 3) -> DataFrame:
    """The legs (src, dst, us, amount, tb) that can lie on a cycle whose times fall within ``w``: another leg comes into the sender and one leaves the receiver, each at most ``w`` away.

    The test is a join from either end on the account and the bucket of time, with what the account does in that bucket and beside it; a leg that goes
    takes others with it, so it is repeated while that removes a tenth of the legs, at most ``rounds`` times. What stays too long costs time, not results.
    """
    legs = cut(legs)
    n = legs.count()
    for _ in range(rounds):

        def around(end: str, at: str) -> DataFrame:
            times = legs.groupBy(F.col(end).alias(at), F.col("tb").alias("b")).agg(F.min("us").alias("t1"), F.max("us").alias("t2"))
            each = times.select(at, F.explode(F.expr("array(b - 1, b, b + 1)")).alias("tb"), F.struct("t1", "t2").alias("x"))
            return each.groupBy(at, "tb").agg(F.collect_list("x").alias("near"))

        close = f"exists(near, x -> us between x.t1 - {w} and x.t2 + {w})"
        fed = legs.join(around("dst", "src"), ["src", "tb"]).where(close).select(*legs.columns)
        legs = cut(fed.join(around("src", "dst"), ["dst", "tb"]).where(close).select(*legs.columns))
        was, n = n, legs.count()
        if n > 0.9 * was:
            break
    return legs


def carousel(edges: DataFrame, *, max_hours: float = 24.0, conservation: float = 0.98, max_nodes: int = 6) -> DataFrame:
    """Members of cycles of 3 to ``max_nodes`` accounts over each pair's latest edge, in time order from some start, amounts alike.

    A cycle is two paths of about half its legs, the second from the end of the first back to its start, so no path is grown over more than half of
    the longest cycle, and paths meet on both their ends. Legs meet on the account and on buckets of time. Paths whose ends no path back joins,
    in a large ledger nearly all, are told by a hash of their ends and aren't shuffled again.
    """
    w = int(max_hours * HOUR)
    last = edges.where("src <> dst").groupBy("src", "dst").agg(F.max_by(F.struct("amount", "us"), F.struct(F.coalesce("us", F.lit(-(1 << 62))), "tx_id")).alias("x")).select("src", "dst", "x.amount", "x.us").where("us is not null").withColumn("tb", time_bucket("us", w))
    last = in_cycles(last, w)
    # amounts of nought alone are alike, as in the SQL
    alike = lambda lo, hi, x, y: f"case when greatest({hi}, {y}) = 0 then least({lo}, {x}) = 0 else least({lo}, {x}) / greatest({hi}, {y}) >= {conservation} end"
    inner = F.expr("cast(array() as array<string>)")
    # s, m, l: the first account of a path, those between, the last
    paths = {1: last.select(F.col("src").alias("s"), inner.alias("m"), F.col("dst").alias("l"), F.col("us").alias("t0"), F.col("us").alias("t"), F.col("amount").alias("lo"), F.col("amount").alias("hi"))}
    onward = last.select("src", "dst", "amount", "us", F.explode(F.expr("array(tb - 1, tb)")).alias("pb"))
    for n in range(2, (max_nodes + 1) // 2 + 1):
        step = paths[n - 1].withColumn("tb", time_bucket("t", w)).join(onward, F.expr(f"l = src and tb = pb and us >= t and us <= t0 + {w} and {alike('lo', 'hi', 'amount', 'amount')} and dst <> s and not array_contains(m, dst)"))
        paths[n] = cut(step.select("s", F.concat("m", F.array("l")).alias("m"), F.col("dst").alias("l"), "t0", F.col("us").alias("t"), F.least("lo", "amount").alias("lo"), F.greatest("hi", "amount").alias("hi")))
    halves = [(n - n // 2, n // 2) for n in range(3, max_nodes + 1)]
    paths = closing(paths, halves)
    rows = []
    for there, back in halves:
        home = paths[back].select(*[F.col(c).alias(f"b_{c}") for c in ("s", "m", "l", "t0", "t", "lo", "hi")])
        both = paths[there].join(home, F.expr(f"l = b_s and s = b_l and b_t0 >= t and b_t <= t0 + {w} and {alike('lo', 'hi', 'b_lo', 'b_hi')} and not arrays_overlap(m, b_m)"))
        rows.append(both.select(F.concat(F.array("s"), "m", F.array("l"), "b_m").alias("p")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    members = every.select(F.explode("p").alias("account_id"), F.array_join("p", " -> ").alias("c")).groupBy("account_id").agg(F.min("c").alias("d"))
    return alert(members, "Carousel Cycle", 0.94, F.col("d"))


def closing(paths: dict[int, DataFrame], halves: list[tuple[int, int]], most: int = 1_000_000) -> dict[int, DataFrame]:
    """The paths (s, l, by number of legs) that another one may lead back from, by hashes of both ends; all of them if over ``most`` hashes are met both ways."""
    ends = F.xxhash64(F.least("s", "l"), F.greatest("s", "l"))
    bit = lambda n, up: 1 << (2 * (n - 1) + up)
    seen = None
    for n, p in paths.items():
        one = p.select(ends.alias("h"), F.when(F.col("s") < F.col("l"), bit(n, 1)).otherwise(bit(n, 0)).cast("long").alias("ways"))
        seen = one if seen is None else seen.unionByName(one)
    met = [f"(ways & {bit(a, up)} <> 0 and ways & {bit(b, 1 - up)} <> 0)" for a, b in halves for up in (0, 1)]
    hit = cut(seen.groupBy("h").agg(F.bit_or("ways").alias("ways")).where(" or ".join(met)).select("h"))
    if hit.count() > most:
        return paths
    return {n: p.withColumn("h", ends).join(F.broadcast(hit), "h", "left_semi").drop("h") for n, p in paths.items()}


def mule(features: DataFrame, *, hawkes: float = 0.75, low: float = 0.96, high: float = 1.04, volume: float = 100_000.0) -> DataFrame:
    hit = features.where((F.col("hawkes_intensity") > hawkes) & F.col("flow_ratio").between(low, high) & (F.col("out_volume") > volume))
    return alert(hit, "Mule Account", 0.88, F.format_string("intensity %.3f", "hawkes_intensity"))


def accumulate_disperse(edges: DataFrame, *, least: int = 4, tolerance: float = 0.05, volume: float = 500_000.0) -> DataFrame:
    """Accounts whose inflows come before their outflows on average, and balance; null times count for volumes only."""
    b = both_ends(edges)
    amount = F.col("amount").cast("decimal(28,6)")
    side = lambda o, c: F.when(F.col("out") == o, c)
    s = b.groupBy("account_id").agg(
        F.sum(1 - F.col("out")).alias("n_in"), F.sum("out").alias("n_out"), F.avg(side(0, F.col("us"))).alias("t_in"), F.avg(side(1, F.col("us"))).alias("t_out"),
        F.sum(side(0, amount)).cast("double").alias("v_in"), F.sum(side(1, amount)).cast("double").alias("v_out"),
    )
    hit = s.where((F.col("n_in") >= least) & (F.col("n_out") >= least) & (F.col("t_in") < F.col("t_out")) & (F.col("v_out") / (F.col("v_in") + 1e-5)).between(1 - tolerance, 1 + tolerance) & (F.col("v_in") > volume))
    return alert(hit, "Accumulate and Disperse", 0.89, F.format_string("in %.2f, out %.2f", "v_in", "v_out"))


def band_join(a: DataFrame, b: DataFrame, *, tolerance: float, seconds: int, cell: int = 2000) -> DataFrame:
    """Pairs of rows (a.*, b.*) with b.amount within ``tolerance`` of a.amount and times within ``seconds``.

    Amounts fall in logarithmic buckets and times in even ones; one side is dealt to neighbouring buckets, so that
    the join is on equal keys and work follows the matches, not the product. A bucket where a side has more than ``cell``
    rows, as round amounts in a busy hour make, is a grid: each row of one side goes to one line of it and each of the other to one
    column, in numbers measured before, so a task meets about ``cell`` rows of each side at a time. Amounts must be positive.
    """
    width, span = -math.log(1 - tolerance), seconds * 1_000_000
    key = lambda df, p: df.where("amount > 0 and us is not null").select(F.struct("*").alias(p), F.floor(F.ln("amount") / width).alias("ab"), F.floor(F.col("us") / span).alias("tb"))
    left = key(a, "a").select("a", F.explode(F.expr("array(ab - 1, ab, ab + 1)")).alias("ab"), "tb").select("a", "ab", F.explode(F.expr("array(tb - 1, tb, tb + 1)")).alias("tb"))
    right = key(b, "b")
    both = left.select("ab", "tb", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(right.select("ab", "tb", F.lit(0).alias("x"), F.lit(1).alias("y")))
    size = both.groupBy("ab", "tb").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where(f"x > 0 and y > 0 and greatest(x, y) > {cell}")
    hot = cut(size.select("ab", "tb", F.ceil(F.col("x") / cell).alias("lines"), F.ceil(F.col("y") / cell).alias("columns")))
    # a row of 32 bytes for each bucket of over ``cell`` rows: broadcast up to 16 MB of them
    grid = F.broadcast(hot) if hot.count() <= 500_000 else hot
    one = lambda df, c: df.join(grid, ["ab", "tb"], "left").na.fill(1, ["lines", "columns"]).withColumn("at", F.pmod(F.xxhash64(f"{c}.tx_id", f"{c}.us", f"{c}.amount"), F.col("lines" if c == "a" else "columns")))
    left = one(left, "a").select("a", "ab", "tb", F.col("at").alias("line"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("column"))
    right = one(right, "b").select("b", "ab", "tb", F.explode(F.expr("sequence(0L, lines - 1)")).alias("line"), F.col("at").alias("column"))
    near = f"b.amount >= a.amount * (1 - {tolerance}) and b.amount <= a.amount * (1 + {tolerance}) and abs(b.us - a.us) <= {span}"
    return left.join(right, ["ab", "tb", "line", "column"]).where(near)


def partner_marks(known: DataFrame, most: int = 1000) -> DataFrame:
    """src, marks: for each account the 16-bit hashes of those it deals with (links u, v), null for accounts of more than ``most`` hashes."""
    ends = known.select(F.col("u").alias("src"), mark("v").alias("m")).unionByName(known.select(F.col("v").alias("src"), mark("u").alias("m"))).distinct()
    return ends.groupBy("src").agg(F.collect_list("m").alias("marks")).select("src", F.when(F.size("marks") <= most, F.col("marks")).alias("marks"))


def mark(account: str):
    return (F.pmod(F.xxhash64(account), F.lit(1 << 16)) - (1 << 15)).cast("short")


def links(edges: DataFrame) -> DataFrame:
    return cut(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())


def ghost_pairs(edges: DataFrame, *, seconds: int = 3600, tolerance: float = 0.05) -> DataFrame:
    """Cross-border and domestic transactions alike in amount and time, whose outer accounts never deal with each other.

    Pairs grow with the square of a busy hour, so they stay in the task that finds them: a sender brings short hashes of the accounts it deals with, and a
    receiver that isn't among them is a stranger. Only pairs whose hashes meet, known ones and few others, are looked up among the links.
    """
    known = links(edges)
    return strangers(edges.where("cb = 1"), edges.where("cb = 0"), known, partner_marks(known), seconds=seconds, tolerance=tolerance)


def strangers(sent: DataFrame, got: DataFrame, known: DataFrame, marks: DataFrame | None, *, seconds: int, tolerance: float) -> DataFrame:
    """Ghost pairs of some sent and some received transactions; without ``marks`` all are looked up among the links, as suits few."""
    sent = sent.select("tx_id", "src", "amount", "us")
    sent = sent.join(marks, "src", "left") if marks is not None else sent.withColumn("marks", F.lit(None).cast("array<smallint>"))
    got = got.select("tx_id", "dst", "amount", "us", mark("dst").alias("m"))
    p = band_join(sent, got, tolerance=tolerance, seconds=seconds).where("a.src <> b.dst")
    names = [F.expr(x) for x in ("a.tx_id as cb_tx", "b.tx_id as dom_tx", "a.src as sender", "b.dst as receiver", "a.amount as amount", "a.us as us")]
    met = "coalesce(array_contains(a.marks, b.m), true)"
    asked = p.where(met).select(*names).join(known, (F.least("sender", "receiver") == F.col("u")) & (F.greatest("sender", "receiver") == F.col("v")), "left_anti")
    return asked if marks is None else p.where(f"not {met}").select(*names).unionByName(asked)


def first_ghosts(edges: DataFrame, n: int, *, seconds: int, tolerance: float, start: int = 1000) -> DataFrame:
    """The first ``n`` ghost pairs by us, cb_tx, amount, dom_tx: those of the earliest sent transactions, of more of them until there are ``n``, at last of all."""
    order = ("us", "cb_tx", "amount", "dom_tx")
    sent = edges.where("cb = 1 and amount > 0 and us is not null")
    known = links(edges)
    while start <= 1_000_000:
        until, taken = sent.select("us").orderBy("us").limit(start).agg(F.max("us"), F.count("*")).first()
        if taken < start:
            break
        got = edges.where(f"cb = 0 and us <= {until + seconds * 1_000_000}")
        p = cut(strangers(sent.where(f"us <= {until}"), got, known, None, seconds=seconds, tolerance=tolerance).orderBy(*order).limit(n))
        if p.count() == n:
            return p
        start *= 32
    return ghost_pairs(edges, seconds=seconds, tolerance=tolerance).orderBy(*order).limit(n)


def ghost_accounts(edges: DataFrame, *, seconds: int, tolerance: float, dense: float = 1.0) -> DataFrame:
    """account_id, tx: both outer accounts of all ghost pairs, with the least sent transaction of a pair of each.

    Where hours are busy nearly every account is in a pair of few of the sent transactions. So these are taken in order of their number, at first about ``dense`` for
    each bucket of amount and time, then eight times as many, at last all; in each round only pairs of accounts without a pair so far are looked for. The
    first round that gives an account a pair gives its least transaction.
    """
    known = links(edges)
    marks = apart(cut(partner_marks(known)))
    width, span = -math.log(1 - tolerance), seconds * 1_000_000
    ab, tb = F.floor(F.ln("amount") / width).alias("ab"), F.floor(F.col("us") / span).alias("tb")
    live = edges.where("amount > 0 and us is not null")
    sent, got = live.where("cb = 1"), live.where("cb = 0")
    n, cells = sent.agg(F.count("*"), F.approx_count_distinct(F.struct(ab, tb))).first()
    share = min(1.0, dense * cells / max(n, 1))
    done, low = None, None
    while True:
        high = sent.agg(F.expr(f"percentile_approx(tx_id, {share})")).first()[0] if share < 1 else None
        part = sent.where(" and ".join(["true", *([f"tx_id > {low}"] if low is not None else []), *([f"tx_id <= {high}"] if high is not None else [])]))
        if done is None:
            p = strangers(part, got, known, marks, seconds=seconds, tolerance=tolerance)
        else:
            new = part.join(done.select(F.col("account_id").alias("src")), "src", "left_anti")
            left = cut(got.join(done.select(F.col("account_id").alias("dst")), "dst", "left_anti").select("tx_id", "dst", "amount", "us"))
            near = left.select(ab, tb).distinct().select(F.explode(F.expr("array(ab - 1, ab, ab + 1)")).alias("ab"), "tb").select("ab", F.explode(F.expr("array(tb - 1, tb, tb + 1)")).alias("tb"))
            old = part.withColumns({"ab": ab, "tb": tb}).join(cut(near.distinct()), ["ab", "tb"], "left_semi").join(done.select(F.col("account_id").alias("src")), "src", "left_semi")
            p = strangers(new, got, known, marks, seconds=seconds, tolerance=tolerance).unionByName(strangers(old, left, known, marks, seconds=seconds, tolerance=tolerance))
        rows = p.select(F.explode(F.array("sender", "receiver")).alias("account_id"), "cb_tx").groupBy("account_id").agg(F.min("cb_tx").alias("tx"))
        if done is not None:
            rows = rows.join(done, "account_id", "left_anti").unionByName(done)
        if share >= 1:
            return rows
        done, low, share = apart(cut(rows)), high, min(1.0, 8 * share)
        ends = sent.select(F.col("src").alias("account_id")).unionByName(got.select(F.col("dst").alias("account_id")))
        if ends.join(done, "account_id", "left_anti").isEmpty():
            return done


def ghost_flow(edges: DataFrame, *, seconds: int = 3600, tolerance: float = 0.05, max_alerts: int | None = 500) -> DataFrame:
    """Both outer accounts of ghost pairs; ``max_alerts`` alerts in order of time, as the limit is part of the rule (None: all)."""
    if max_alerts:
        p = first_ghosts(edges, max_alerts // 2, seconds=seconds, tolerance=tolerance)
        rows = p.select(F.explode(F.array("sender", "receiver")).alias("account_id"), "cb_tx").groupBy("account_id").agg(F.min("cb_tx").alias("tx"))
    else:
        rows = ghost_accounts(edges, seconds=seconds, tolerance=tolerance)
    return alert(rows, "Hawala Ghost Flow", 0.90, F.format_string("from transaction %d", "tx"))


def loan_back(edges: DataFrame, features: DataFrame, *, pagerank: float = 0.002, low: float = 0.95, high: float = 1.05) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    mutual = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select(F.col("src").alias("account_id")).distinct()
    hit = features.where((F.col("pagerank") > pagerank) & F.col("flow_ratio").between(low, high)).join(mutual, "account_id", "left_semi")
    return alert(hit, "Loan-Back", 0.80, F.format_string("pagerank %.4f", "pagerank"))


def ghost_payroll(edges: DataFrame, features: DataFrame, *, min_edges: int = 10, min_recipients: int = 5, low: float = 0.9, high: float = 1.1, hours: float = 12.0, volume: float = 500_000.0) -> DataFrame:
    """Hubs whose receivers pass payments on to one target; the first onward edge of each receiver's payment counts.

    A hub has ``min_edges`` links out, of any relation: its payments and, for an account of the register (``features``), the link to its branch;
    and ``min_recipients`` payments.
    """
    w = int(hours * HOUR)
    placed = features.select(F.col("account_id").alias("src"), F.lit(1).alias("branch")).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= min_recipients)
    hubs = out.join(placed, "src", "left").where(F.col("n") + F.coalesce("branch", F.lit(0)) >= min_edges).select("src")
    even = features.where(F.col("flow_ratio").between(low, high)).select(F.col("account_id").alias("dst"))
    pay = edges.where("us is not null").join(hubs, "src", "left_semi").join(even, "dst", "left_semi").select(F.col("tx_id").alias("pay"), F.col("src").alias("hub"), F.col("dst").alias("mid"), F.col("us").alias("t"))
    pay = pay.withColumn("pb", F.explode(ahead_of("t", w)))
    on = edges.where("us is not null").select(F.col("src").alias("mid"), F.col("dst").alias("target"), "amount", "us", "tx_id").withColumn("tb", time_bucket("us", w))
    first = pay.join(on, (pay["mid"] == on["mid"]) & (pay["pb"] == on["tb"]) & (on["us"] > pay["t"]) & (on["us"] <= pay["t"] + w))
    first = first.groupBy("pay", "hub").agg(F.min_by(F.struct("target", "amount"), F.struct("us", "tx_id")).alias("x")).select("hub", "x.target", "x.amount")
    hit = first.groupBy("hub", "target").agg(money_sum("amount").alias("v")).where(F.col("v") > volume)
    rows = hit.select(F.explode(F.array("hub", "target")).alias("account_id"), "v").groupBy("account_id").agg(F.max("v").alias("v"))
    return alert(rows, "Ghost Payroll", 0.92, F.format_string("volume %.2f", "v"))


def shell_layering(edges: DataFrame, features: DataFrame, communities: DataFrame, *, ratio: float = 0.95, share: float = 0.85, volume: float = 500_000.0) -> DataFrame:
    """Current accounts fed from their own community; acct_type comes from the account table."""
    c = communities.select("account_id", "community_id")
    e = edges.join(c.select(F.col("account_id").alias("src"), F.col("community_id").alias("cs")), "src", "left").join(c.select(F.col("account_id").alias("dst"), F.col("community_id").alias("cd")), "dst", "left")
    amount = F.col("amount").cast("decimal(28,6)")
    v = e.groupBy(F.col("dst").alias("account_id")).agg(F.sum(amount).cast("double").alias("v"), F.coalesce(F.sum(F.when(F.col("cs") == F.col("cd"), amount)), F.lit(0)).cast("double").alias("own"))
    hit = features.where((F.col("acct_type") == "CURRENT") & (F.col("flow_ratio") > ratio)).join(v, "account_id").where((F.col("own") / F.col("v") > share) & (F.col("v") > volume))
    return alert(hit, "Shell Layering", 0.87, F.format_string("share %.3f", F.col("own") / F.col("v")))


def dedup(alerts: DataFrame) -> DataFrame:
    """The alert of highest confidence per account and typology, ties to the least details."""
    best = alerts.groupBy("account_id", "typology").agg(F.min_by(F.struct("confidence", "details"), F.struct((-F.col("confidence")).alias("c"), "details")).alias("x"))
    return best.select("account_id", "typology", "x.confidence", "x.details")
