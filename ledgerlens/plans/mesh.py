"""The whole analysis from a register, a ledger and reports to ranked scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import embed, flow, graph, learn, risk, text, typology


def run(accounts: DataFrame, edges: DataFrame, entities: DataFrame | None = None, labels: DataFrame | None = None, *, train_model: bool = True, embeddings: bool = True, **params) -> dict[str, DataFrame]:
    """features, alerts, links, verification, scores, metrics (and attributions, if a model was trained).

    Shared inputs are cut once: the edges, the core features and the alerts. Without labels of both classes the
    heuristic score stands in for the model, and ``metrics`` says so. ``params`` are those of ``learn.pipeline``.
    """
    edges = graph.cut(edges)
    comm = graph.cut(graph.leiden(edges, accounts))
    core = flow.core_features(accounts, edges)
    parts = [graph.pagerank(edges), graph.burt_constraint(edges, accounts), comm, graph.scan(edges, accounts), graph.betti_persistence(edges, accounts), graph.motif_triangles_cycles(edges), graph.motif_fans(edges)]
    f = core
    for p in parts:
        f = f.join(p, "account_id", "left")
    ids = comm.select("community_id").distinct().withColumn("n", F.xxhash64("community_id"))
    ratio = graph.community_cb_ratio(edges, comm.join(ids, "community_id").select("account_id", F.col("n").alias("community_id"))).withColumnRenamed("community_id", "n")
    f = f.withColumn("n", F.xxhash64("community_id")).join(ratio, "n", "left").drop("n")
    f = graph.cut(f.na.fill(0))
    out: dict[str, DataFrame] = {}
    wide = f
    if embeddings:
        for name, e in (("dw", embed.netmf(edges, accounts)), ("tgat", embed.tgat(edges, f)), ("han", embed.han(accounts, f))):
            wide = wide.join(embed.wide(e, name), "account_id", "left")
    out["features"] = wide
    links = text.link_entities(entities, accounts) if entities is not None else None
    empty = "report_id string, account_id string, claim_type string, verification_status string"
    out["verification"] = graph.cut(text.verify_claims(text.extract_claims(links), f)) if links is not None else accounts.sparkSession.createDataFrame([], empty)
    if links is not None:
        out["links"] = links
    found = [
        typology.layering(edges, f), typology.structuring(f), typology.carousel(edges), typology.mule(f), typology.accumulate_disperse(edges), typology.ghost_flow(edges), typology.loan_back(edges, f), typology.ghost_payroll(edges, f),
        typology.shell_layering(edges, f, comm),
    ]
    alerts = found[0]
    for a in found[1:]:
        alerts = alerts.unionByName(a)
    out["alerts"] = graph.cut(typology.dedup(alerts))
    trained = False
    if train_model and labels is not None:
        data = graph.cut(learn.attach_labels(f.drop("community_id", "scan_cluster"), labels))
        if data.select("is_suspicious").distinct().count() == 2:
            scores, model, cols = learn.train_and_score(data, **params)
            trained = True
            out["attributions"] = learn.tree_shap(model, learn.model_input(data, cols))
    if not trained:
        scores = risk.heuristic_score(f)
    fused = graph.cut(risk.fuse(scores, f, out["alerts"], out["verification"]))
    spread = risk.contagion(fused, edges).select("account_id", F.col("risk").alias("risk_score"), F.col("base").alias("risk_score_fused"))
    out["scores"] = graph.cut(risk.rank_scores(spread).select("rank", "account_id", "risk_score", "risk_score_fused", "risk_percentile", "risk_band"))
    bands = out["scores"].groupBy("risk_band").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_band", "n")))).alias("risk_counts"))
    out["metrics"] = bands.join(F.broadcast(out["scores"].agg(F.count("*").alias("feature_rows"), F.max("risk_score").alias("max_risk_score")))).withColumn("model_trained", F.lit(trained)).withColumn("feature_columns", F.lit(len(wide.columns)))
    return out
