"""Streams against their batch forms; late rows and idle accounts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import flow, typology
from ledgerlens.streaming import bursts

HOUR = 3_600_000_000


def table(spark, rows):
    t = spark.createDataFrame(rows, "tx_id long, src string, dst string, amount double, us long, cb int")
    return t.withColumn("ts", F.timestamp_micros("us"))


def streamed(spark, tmp_path, batches, query, mode, name):
    """All rows that the query tells, batch after batch (a file each)."""
    schema = None
    for i, rows in enumerate(batches):
        t = table(spark, rows)
        schema = t.schema
        t.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # files are taken in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = query(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return spark.table(name).collect()


def test_ghost_flows_equal_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, f"a{rnd.randint(0, 9)}", f"b{rnd.randint(0, 9)}", rnd.choice([100.0, 102.0, 96.0, 250.0]), rnd.randint(0, 5 * 3600) * 1_000_000, i % 2) for i in range(120)]
    batches = [rows[:60], rows[60:]]
    got = streamed(spark, tmp_path, batches, lambda s: bursts.ghost_flows(s, late="6 hours"), "append", "ghosts")
    p = typology.band_join(table(spark, rows).where("cb = 1"), table(spark, rows).where("cb = 0"), tolerance=0.05, seconds=3600).where("a.src <> b.dst")
    want = sorted((r.a, r.b) for r in p.select("a.tx_id", "b.tx_id").toDF("a", "b").collect())
    assert sorted((r.cb_tx, r.dom_tx) for r in got) == want and want


def test_known_pairs_are_no_ghosts(spark, tmp_path):
    rows = [(1, "a", "x", 100.0, 9 * HOUR, 1), (2, "y", "b", 101.0, 9 * HOUR + HOUR // 2, 0), (3, "y", "c", 101.0, 9 * HOUR + HOUR // 2, 0)]
    known = spark.createDataFrame([("a", "b")], "u string, v string")
    got = streamed(spark, tmp_path, [rows], lambda s: bursts.ghost_flows(s, known=known), "append", "strangers")
    assert [(r.sender, r.receiver) for r in got] == [("a", "c")]


def test_intensity_forgets_idle_accounts(spark, tmp_path):
    first = [(1, "a", "x", 1.0, HOUR, 0), (2, "a", "x", 1.0, 2 * HOUR, 0), (3, "b", "x", 1.0, 2 * HOUR, 0)]
    later = [(4, "c", "x", 1.0, 500 * HOUR, 0)]
    last = [(5, "c", "x", 1.0, 501 * HOUR, 0), (6, "late", "x", 1.0, HOUR, 0)]
    got = streamed(spark, tmp_path, [first, later, last], lambda s: bursts.running_intensity(s, idle_hours=10.0), "update", "intensity")
    told = {}
    for r in got:
        told.setdefault(r.account_id, []).append(r.hawkes_intensity)
    batch = {r.account_id: r.hawkes_intensity for r in flow.hawkes(table(spark, first)).collect()}
    assert told["a"][0] == pytest.approx(batch["a"]) and told["a"][-1] == 0.01 and told["b"][-1] == 0.01
    assert told["c"][-1] == pytest.approx(0.01 + 0.5 * 2.718281828 ** -1)
