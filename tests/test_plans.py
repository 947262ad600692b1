"""The whole analysis, the serving queries, the streams and the driver entry."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import mesh, registry, serve
from ledgerlens.sources import ledger
from ledgerlens.streaming import bursts

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def analysed(spark):
    e, a = ledger.event_ledger(spark, SF), ledger.event_accounts(spark, SF)
    people = spark.createDataFrame([("R1", "a", "b", "37", "large sums, fast"), ("R2", "x", "y", "none", "")], "report_id string, first_name string, last_name string, tax_number string, narrative string")
    return mesh.run(a, e, people, embeddings=False)


def test_mesh(analysed):
    s = analysed["scores"].collect()
    assert sorted(r["rank"] for r in s) == list(range(1, 16)) and all(0 <= r.risk_score <= 1 for r in s)
    v = analysed["verification"].collect()
    assert {r.claim_type for r in v} == {"high_volume", "rapid_movement"} and {r.account_id for r in v} == {"1"}
    m = analysed["metrics"].first()
    assert m.feature_rows == 15 and not m.model_trained and sum(m.risk_counts.values()) == 15


def test_serving(spark, analysed):
    s = serve.loaded_scores(analysed["scores"].select("account_id", "risk_score"))
    top = serve.high_risk(s, analysed["features"], 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0].structural_constraint > 0
    assert serve.overview(s).first().accounts == 15 and serve.filtered_queue(s, 2.0).count() == 0
    assert serve.account_features(analysed["features"], "nobody").count() == 0 and serve.alerts(analysed["alerts"], 5).count() <= 5
    nodes, links = serve.subgraph(ledger.event_ledger(spark, SF), "7")
    assert links.count() == 200 and nodes.where("id = '7'").first().role == "target"


def test_streams(spark, tmp_path):
    hour = 3600
    rows = [("a", 10.0, 0), ("a", 5.0, 60), ("b", 1.0, hour), ("a", 2.0, 2 * hour)]
    t = spark.createDataFrame(rows, "src string, amount double, s long").select("src", "amount", F.timestamp_seconds("s").alias("ts"), (F.col("s") * 1_000_000).alias("us"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))

    def ran(f, mode):
        name = f.__name__
        q = f(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    v = {(r.account_id, r.start.hour): r.amount for r in ran(bursts.hourly_volumes, "complete")}
    assert v["a", 0] == 15.0 and v["b", 1] == 1.0 and v["a", 2] == 2.0
    got = {r.account_id: r.hawkes_intensity for r in ran(bursts.running_intensity, "update")}
    from ledgerlens.operators.flow import hawkes

    whole = {r.account_id: r.hawkes_intensity for r in hawkes(t.select(F.monotonically_increasing_id().alias("tx_id"), "src", F.lit("z").alias("dst"), "amount", "us", F.lit(0).alias("cb"))).collect()}
    assert got["a"] == pytest.approx(whole["a"]) and got["b"] == pytest.approx(whole["b"])


@pytest.mark.parametrize("name", ["flow_features", "motif_triangles_cycles", "scan_clusters", "ghost_payroll", "risk_percentile", "link_cascade", "pr_metrics"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "part", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).values.tolist()))
    assert key(got) == key(want)


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "ledgerlens", tmp_path / "ledgerlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "ledgerlens/llm/__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'high_risk_queue' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code.replace("startswith('op')", "startswith('op1_')")], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
