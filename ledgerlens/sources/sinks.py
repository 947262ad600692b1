"""Writing results: CSV and JSON folders, and the graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.ledger import first_existing, with_defaults


def write_csv(df: DataFrame, path: str, *, skip_empty: bool = False) -> bool:
    """A CSV folder with a header in place of what was there; with ``skip_empty`` a table without rows is not written. Whether it was."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines with sorted keys; nulls are kept as such."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_graph(accounts: DataFrame, transactions: DataFrame, path: str) -> None:
    """``path``/nodes and ``path``/edges as parquet for a graph store: accounts with name and bank, and transactions between known ones."""
    nodes = with_defaults(accounts, {"name": "Unknown Entity"}).select(
        F.col("account_id").cast("string").alias("id"), "name", F.coalesce(first_existing(accounts, ["bank", "institution"]).cast("string"), F.lit("KYC Pending")).alias("bank"), F.lit(0.0).alias("risk_score")
    )
    known = nodes.select("id").distinct()
    t = transactions
    rows = t.select(
        F.col("Sender_account").cast("string").alias("source"), F.col("Receiver_account").cast("string").alias("target"), first_existing(t, ["amount_local_npr"]).cast("double").alias("amount"),
        first_existing(t, ["Date"]).cast("string").alias("date"), first_existing(t, ["Time"]).cast("string").alias("time"),
        F.coalesce(first_existing(t, ["Payment_currency"]).cast("string"), F.lit("NPR")).alias("currency"), F.coalesce(first_existing(t, ["cross_border_flag"]).cast("int"), F.lit(0)).alias("cross_border"),
    )
    both = rows.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    both.write.mode("overwrite").parquet(f"{path}/edges")


#: Results of the whole analysis by file name; the ones marked are written only with rows.
TABLES = {"links": ("extracted_entities", False), "features": ("node_features", False), "verification": ("str_verification", True), "alerts": ("alerts", True), "scores": ("risk_scores", False), "attributions": ("shap_explanations", False)}


def save(results: dict[str, DataFrame], folder: str) -> list[str]:
    """The results of ``mesh.run`` as CSV folders and ``model_metrics`` as JSON; the names written."""
    done = []
    for key, (name, some) in TABLES.items():
        if key in results and write_csv(results[key], f"{folder}/{name}.csv", skip_empty=some):
            done.append(name)
    if "metrics" in results:
        write_json(results["metrics"], f"{folder}/model_metrics.json")
        done.append("model_metrics")
    return done
