"""The analyst's queries as functions of the scored tables; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import clip
from ledgerlens.operators import graph, risk, text

#: Features shown in the queue, with what a missing one shows.
SHOWN = {"flow_ratio": 0.0, "dfa_score": 0.0, "hawkes_intensity": 0.0, "tps_score": 0.0, "structural_constraint": 1.0}


def loaded_scores(scores: DataFrame) -> DataFrame:
    """Scores as a server keeps them: ids as text, scores within 0 and 1, missing percentile, band and rank derived."""
    s = scores.withColumn("account_id", F.col("account_id").cast("string")).withColumn("risk_score", clip(F.col("risk_score")))
    missing = {"risk_percentile", "risk_band", "rank"} - set(s.columns)
    if missing:
        keep = [c for c in s.columns if c not in ("risk_percentile", "risk_band", "rank")]
        s = risk.rank_scores(s.select(*keep))
    return s


def high_risk(scores: DataFrame, features: DataFrame, limit: int = 250) -> DataFrame:
    """The first ``limit`` accounts by rank; the limit is applied before the join."""
    top = scores.orderBy("rank", "account_id").limit(limit)
    have = [c for c in SHOWN if c in features.columns]
    out = top.join(features.select("account_id", *have), "account_id", "left")
    return out.select(*scores.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in SHOWN.items()]).orderBy("rank")


def filtered_queue(scores: DataFrame, least: float = 0.5, bands: tuple[str, ...] = ("CRITICAL", "SEVERE", "HIGH")) -> DataFrame:
    return scores.where((F.col("risk_score") >= least) & F.col("risk_band").isin(*bands)).orderBy("rank")


def overview(scores: DataFrame) -> DataFrame:
    """One row: accounts, critical ones, greatest score."""
    return scores.agg(F.count("*").alias("accounts"), F.count_if(F.col("risk_band") == "CRITICAL").alias("critical"), F.max("risk_score").alias("max_score"))


def account_features(features: DataFrame, account: str) -> DataFrame:
    """The account's features as one record; no row if it is unknown, NaN as null."""
    row = features.where(F.col("account_id") == account)
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in features.dtypes]
    return row.select(*clean)


def records(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, keys in column order; NaN and missing values are nulls, which are kept."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))


def account_shap(attributions: DataFrame, account: str, top: int = 15) -> DataFrame:
    return attributions.where(F.col("account_id") == account).orderBy(F.desc("abs_shap_value"), "feature").limit(top)


def account_claims(verified: DataFrame, account: str) -> DataFrame:
    return text.claim_texts(verified.where(F.col("account_id") == account))


def account_path(edges: DataFrame, account: str) -> DataFrame:
    return graph.alluvial_path(edges, account)


def alerts(found: DataFrame, limit: int = 500) -> DataFrame:
    return found.orderBy(F.desc("confidence"), "account_id", "typology").limit(limit)


def subgraph(edges: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, role; links) of the two-hop neighbourhood; a node has its first role."""
    links = graph.two_hop_subgraph(edges, account)
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("role_source").alias("role")), F.struct(F.col("dst").alias("id"), F.col("role_target").alias("role")))).alias("x")).select("x.*")
    return ends.distinct(), links


def decoded_cluster(clusters: DataFrame) -> DataFrame:
    name = F.when(F.col("scan_cluster").isin("HUB", "OUTLIER"), F.col("scan_cluster")).otherwise(F.concat(F.lit("Cluster "), F.col("scan_cluster")))
    return clusters.withColumn("scan_label", name)
