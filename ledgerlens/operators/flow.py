"""Per-account flow features over edges (tx_id, src, dst, amount, us, cb)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import money_sum

#: Words that mark institutions in account names.
WHITELIST = ("GOVERNMENT", "TAX", "TELECOM", "UTILITY", "CLEARINGHOUSE", "MINISTRY", "MUNICIPALITY", "REVENUE", "HOSPITAL", "UNIVERSITY")


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end in one pass: account_id, out (1 for the sender), the edge's columns."""
    sides = F.explode(F.array(F.struct(F.col("src").alias("account_id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("account_id"), F.lit(0).alias("out")))).alias("s")
    return edges.select("*", sides).select("s.account_id", "s.out", *edges.columns)


def flow_features(edges: DataFrame) -> DataFrame:
    """account_id, in_volume, out_volume, flow_ratio, dfa_score, degrees: one shuffle for both directions."""
    amount = F.col("amount").cast("decimal(28,6)")
    v = both_ends(edges).groupBy("account_id").agg(
        F.coalesce(F.sum(F.when(F.col("out") == 0, amount)), F.lit(0)).cast("double").alias("in_volume"), F.coalesce(F.sum(F.when(F.col("out") == 1, amount)), F.lit(0)).cast("double").alias("out_volume"),
        F.sum(1 - F.col("out")).alias("in_degree"), F.sum("out").cast("long").alias("out_degree"),
    )
    total = F.col("in_volume") + F.col("out_volume")
    return v.withColumn("flow_ratio", F.col("out_volume") / (F.col("in_volume") + 1e-5)).withColumn("dfa_score", F.when(total == 0, 0.0).otherwise(F.abs(F.col("out_volume") - F.col("in_volume")) / (total + 1e-5))).withColumn("in_degree", F.col("in_degree").cast("long"))


def hawkes(edges: DataFrame, mu: float = 0.01, alpha: float = 0.5, beta: float = 1.0) -> DataFrame:
    """account_id, hawkes_intensity: decayed count of an account's events, in hours before its last one, that one left out."""
    t = both_ends(edges.where("us is not null")).select("account_id", "us")
    last = t.groupBy("account_id").agg(F.max("us").alias("mx"))
    decay = F.exp(-beta * ((F.col("mx") - F.col("us")) / 3.6e9))
    return t.join(last, "account_id").groupBy("account_id").agg((mu + alpha * (F.sum(decay) - 1)).alias("hawkes_intensity"))


def tps(edges: DataFrame, threshold: float = 1e6, tolerance: float = 0.1) -> DataFrame:
    """account_id, tps_score, band_recipients: share of sent amounts just below the threshold, and how many receivers they have."""
    inside = (F.col("amount") >= threshold * (1 - tolerance)) & (F.col("amount") < threshold)
    return edges.groupBy(F.col("src").alias("account_id")).agg((F.count_if(inside) / F.count("*")).alias("tps_score"), F.count_distinct(F.when(inside, F.col("dst"))).alias("band_recipients"))


def core_features(accounts: DataFrame, edges: DataFrame, threshold: float = 1e6, tolerance: float = 0.1) -> DataFrame:
    """Accounts with flow, temporal and threshold features; accounts without edges get zeros."""
    out = accounts.select("account_id", "acct_type").join(flow_features(edges), "account_id", "left").join(hawkes(edges), "account_id", "left").join(tps(edges, threshold, tolerance), "account_id", "left")
    return out.na.fill(0)


def collapse(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: src, dst, w, n."""
    return edges.groupBy("src", "dst").agg(money_sum("amount").alias("w"), F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different ends: u < v."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("k"), F.col("v").alias("o")).unionByName(pairs.select(F.col("v").alias("k"), F.col("u").alias("o")))


def whitelist(accounts: DataFrame, edges: DataFrame, receipts: int = 100) -> DataFrame:
    """account_id, reason: institutions by name or by number of receipts; a table to look at, filters nothing."""
    named = accounts.where(F.upper("name").rlike("|".join(WHITELIST))).select("account_id", F.lit("keyword").alias("reason"))
    busy = edges.groupBy(F.col("dst").alias("account_id")).count().where(f"count > {receipts}").select("account_id", F.lit("receipts").alias("reason"))
    return named.unionByName(busy).groupBy("account_id").agg(F.min("reason").alias("reason"))


def multigraph(accounts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, type) and (edges: source, target, relation, amount, us, cb) of the heterogeneous graph; accounts of one name share a customer.

    Transactions with banks and countries of both ends (src_bank, src_country, dst_bank, dst_country) place these banks in these
    countries, each pair once; without them every account's bank is in 'NP'.
    """
    cust = F.when(F.col("name") != "", F.concat(F.lit("cust_"), F.replace("name", F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("cust_"), F.col("account_id")))
    a = accounts.withColumn("customer", cust)
    kinds = [("account_id", "Account"), ("customer", "Customer"), ("branch", "Branch"), ("institution", "Bank")]
    links = [("customer", "account_id", "OWNS"), ("account_id", "branch", "LOCATED_IN"), ("branch", "institution", "LOCATED_IN")]
    if {"src_bank", "src_country", "dst_bank", "dst_country"} <= set(edges.columns):
        ends = F.explode(F.expr("array(struct(src_bank as bank, src_country as country), struct(dst_bank as bank, dst_country as country))")).alias("x")
        placed = edges.select(ends).select("x.*").where("bank is not null and country is not null").distinct()
    else:
        placed = a.select(F.col("institution").alias("bank"), F.lit("NP").alias("country")).distinct()
    node = lambda df, kinds: df.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(t).alias("type")) for c, t in kinds])).alias("n")).select("n.*")
    nodes = node(a, kinds).unionByName(node(placed, [("bank", "Bank"), ("country", "Country")])).distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("amount", "double"), ("us", "long"), ("cb", "int"))]
    fixed = a.select(F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("target"), F.lit(r).alias("relation")) for x, y, r in links])).alias("l")).select("l.*", *none)
    where = placed.select(F.col("bank").alias("source"), F.col("country").alias("target"), F.lit("LOCATED_IN").alias("relation"), *none)
    if "src_bank" not in edges.columns:  # as the register has them, one for each account
        where = a.select(F.col("institution").alias("source"), F.lit("NP").alias("target"), F.lit("LOCATED_IN").alias("relation"), *none)
    sends = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("SENDS").alias("relation"), "amount", "us", "cb")
    return nodes, sends.unionByName(fixed).unionByName(where)
