"""Evidence fusion, contagion, ranking, explanation and case assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import clip, money_sum, risk_band
from ledgerlens.operators.graph import beside, cut
from ledgerlens.operators.order import sums_before

#: Feature-name tokens of the driver groups, tried in order.
DRIVER_GROUPS = (
    ("self_behavior", ("sent_", "sender_", "tx_count", "velocity", "amount", "threshold", "tps", "dfa", "hawkes")),
    ("counterparty", ("received_", "receiver_", "counterparty", "neighbor", "degree")),
    ("community", ("community", "leiden", "cluster", "structural_hole", "constraint")),
    ("external", ("cross_border", "country_risk", "currency", "sanctions", "pep")),
)


def heuristic_score(features: DataFrame, label: str | None = None) -> DataFrame:
    """account_id, risk_score: the label, and an account's volume against the largest.

    The volume is multiplied before it is divided, as in the SQL: the other way round sums that differ by their last bit tie otherwise, and ranks with them.
    """
    volume = F.col("in_volume") + F.col("out_volume")
    most = features.agg(F.max(volume).alias("most"))
    known = F.coalesce(F.col(label), F.lit(0)) if label else F.lit(0)
    share = F.when(F.col("most") > 0, 0.4 * volume / F.col("most")).otherwise(0.0)
    return features.join(F.broadcast(most)).select("account_id", clip(0.6 * known + share).alias("risk_score"))


def combine(m1: str, m2: str) -> str:
    """SQL of Dempster's rule for structs of (s, n, t); near-total conflict takes the greater belief and the lesser doubt."""
    k = f"({m1}.s * {m2}.n + {m1}.n * {m2}.s)"
    s, n, t = f"({m1}.s * {m2}.s + {m1}.s * {m2}.t + {m1}.t * {m2}.s)", f"({m1}.n * {m2}.n + {m1}.n * {m2}.t + {m1}.t * {m2}.n)", f"({m1}.t * {m2}.t)"
    total = f"({s} + {n} + {t})"
    return (
        f"case when {k} >= 0.999D then struct(greatest({m1}.s, {m2}.s) as s, least({m1}.n, {m2}.n) as n, 0D as t) when {total} = 0 then struct(0D as s, 1D as n, 0D as t) "
        f"else struct({s} / {total} as s, {n} / {total} as n, {t} / {total} as t) end"
    )


def fuse(scores: DataFrame, features: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """account_id, risk_score, belief, plausibility from model, graph, alert and report evidence, in that order."""
    typ = alerts.groupBy("account_id").agg(F.max("confidence").alias("tp"))
    told = F.when(F.col("verification_status") == "CONFIRMED", 0.95).when(F.col("verification_status") == "REFUTED", 0.1).otherwise(0.4)
    order = F.when(F.col("verification_status") == "CONFIRMED", 3).when(F.col("verification_status") == "REFUTED", 2).otherwise(1)
    rep = verdicts.groupBy("account_id").agg(F.max_by(told, order).alias("sp"))
    f = features.select("account_id", "hawkes_intensity").join(scores, "account_id", "left").join(typ, "account_id", "left").join(rep, "account_id", "left")
    f = f.selectExpr("account_id", "coalesce(risk_score, 0.01D) as p", "least(coalesce(hawkes_intensity, 0D) / 5D, 1D) as g", "coalesce(tp, 0D) as tp", "coalesce(sp, 0D) as sp")
    f = f.withColumn("m1", F.expr("struct(0.8D * p as s, 0.8D * (1D - p) as n, 0.2D as t)")).withColumn("m2", F.expr("struct(0.7D * g as s, 0.7D * (1D - g) as n, 0.3D as t)"))
    f = f.withColumn("m3", F.expr("struct(0.9D * tp as s, 0D as n, 1D - 0.9D * tp as t)")).withColumn("m4", F.expr("struct(sp as s, 0D as n, 1D - sp as t)"))
    f = f.withColumn("c1", F.expr(combine("m1", "m2"))).withColumn("c2", F.expr(combine("c1", "m3"))).withColumn("c3", F.expr(combine("c2", "m4")))
    return f.select("account_id", F.col("p").alias("risk_score"), F.col("c3.s").alias("belief"), (F.col("c3.s") + F.col("c3.t")).alias("plausibility"))


def contagion(scores: DataFrame, edges: DataFrame, *, iterations: int = 5, alpha: float = 0.05, factor: float = 0.35, score: str = "belief") -> DataFrame:
    """account_id, base, risk: risk flows along edges by amount share and age. Weights are made once; each step is one join and one sum."""
    inflow = edges.groupBy("dst").agg(money_sum("amount").alias("ti"), F.max("us").alias("tr"))
    hours = F.greatest(F.lit(0.0), (F.col("tr") - F.col("us")) / 3.6e9)
    decay = F.when(F.col("us").isNull(), 1.0).otherwise(F.exp(-alpha * hours))
    base = cut(scores.select("account_id", F.col(score).alias("f")))
    n = base.count()
    w = cut(edges.join(inflow, "dst").groupBy("src", "dst").agg(F.sum(F.col("amount") / (F.col("ti") + 1e-9) * decay).alias("w")))
    r = base.select("account_id", F.col("f").alias("r"))
    for _ in range(iterations):
        got = w.join(beside(r.select(F.col("account_id").alias("src"), "r"), n), "src").groupBy(F.col("dst").alias("account_id")).agg(F.sum(F.col("w") * F.col("r")).alias("x"))
        r = base.join(got, "account_id", "left").select("account_id", F.least(F.col("f") + factor * F.coalesce("x", F.lit(0.0)), F.lit(1.0)).alias("r"))
    return base.join(r, "account_id").select("account_id", F.col("f").alias("base"), F.col("r").alias("risk"))


def rank_scores(scores: DataFrame, score: str = "risk_score") -> DataFrame:
    """The rows with risk_percentile (average ties), risk_band and rank (score descending, then account; from 1).

    Both come from sums over ranges of the order: rows of one score are spread over ranges by account, so neither all
    scores nor one that many accounts share pass through one task. Null scores rank last and have the least percentiles.
    """
    placed, _ = sums_before(scores, [F.desc_nulls_last(score), F.col("account_id")], {"rank": F.lit(1)})
    per, total = sums_before(placed.groupBy(score).agg(F.count("*").alias("_c")), [F.asc_nulls_first(score)], {"_below": F.col("_c")})
    out = placed.join(per.withColumnRenamed(score, "_s"), F.col(score).eqNullSafe(F.col("_s")))
    pct = (F.col("_below") + (F.col("_c") + 1) / 2.0) / float(max(total["_below"], 1)) * 100
    ranked = out.withColumn("risk_percentile", pct).withColumn("risk_band", risk_band(F.col(score)))
    return ranked.select(*scores.columns, "risk_percentile", "risk_band", (F.col("rank") + 1).cast("long").alias("rank"))


def driver_group(feature):
    out = F.lit("self_behavior")
    for name, tokens in reversed(DRIVER_GROUPS):
        out = F.when(F.lower(feature).rlike("|".join(tokens)), name).otherwise(out)
    return out


def driver_shares(attributions: DataFrame) -> DataFrame:
    """account_id, driver_group, share of absolute attribution; all four groups for every account."""
    a = attributions.withColumn("driver_group", driver_group(F.col("feature")))
    names = [g for g, _ in DRIVER_GROUPS]
    sums = a.groupBy("account_id").agg(*[F.coalesce(F.sum(F.when(F.col("driver_group") == g, F.abs("shap_value"))), F.lit(0.0)).alias(g) for g in names])
    total = F.expr(" + ".join(names))
    safe = F.when(total == 0, 1.0).otherwise(total)
    return sums.select("account_id", F.explode(F.array(*[F.struct(F.lit(g).alias("driver_group"), (F.col(g) / safe).alias("share")) for g in names])).alias("x")).select("account_id", "x.*")


def counterfactual_edges(edges: DataFrame, account: str, *, factor: float = 0.6, top: int = 25) -> DataFrame:
    """tx_id, src, dst, amount, risk_drop of the account's edges that count most; a self-loop is listed as the two edges it is."""
    amount = F.coalesce("amount", F.lit(1.0))
    mine = edges.where((F.col("src") == account) | (F.col("dst") == account)).select("tx_id", "src", "dst", amount.alias("amount"), F.explode(F.expr("case when src = dst then array(0, 1) else array(0) end")).alias("side"))
    total = mine.agg(money_sum("amount").alias("total"))
    drop = F.bround(F.col("amount") / F.col("total") * factor, 6)
    return mine.join(F.broadcast(total)).select("tx_id", "src", "dst", "amount", drop.alias("risk_drop")).orderBy(F.desc("risk_drop"), "tx_id").limit(top)


def case_records(ranked: DataFrame, features: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per account with score, volumes, typologies and claims; accounts without a score get the defaults."""
    typ = alerts.groupBy("account_id").agg(F.array_sort(F.collect_set("typology")).alias("typologies"))
    said = verdicts.groupBy("account_id", "claim_type").agg(F.max("verification_status").alias("s")).groupBy("account_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("claim_type", "s")))).alias("claims"))
    c = features.select("account_id", "in_volume", "out_volume").join(ranked.select("account_id", "risk_score", "risk_band", "rank"), "account_id", "left").join(typ, "account_id", "left").join(said, "account_id", "left")
    return c.select("account_id", F.coalesce("risk_score", F.lit(0.5)).alias("risk_score"), F.coalesce("risk_band", F.lit("HIGH")).alias("risk_band"), "rank", "in_volume", "out_volume", F.coalesce("typologies", F.expr("cast(array() as array<string>)")).alias("typologies"), F.coalesce("claims", F.expr("cast(map() as map<string, string>)")).alias("claims"))
