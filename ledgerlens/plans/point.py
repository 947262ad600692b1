"""Questions about one account, answered from a stored index of the ledger instead of a scan of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.flow import both_ends
from ledgerlens.sources.shared import shared_dir

COLUMNS = "account string, other string, out int, us long, tx_id long, src string, dst string, amount double, cb int"


class LedgerIndex:
    """A table with a row for each end of each transaction, bucketed by account and sorted within files by account, time and id.

    A question about an account reads its bucket alone, and there the row groups that can hold it. The table is stored once, under
    ``location`` (by default in the shared folder), and can be opened by other sessions. Accounts of many rows are dealt over
    ``slices`` files of their bucket, so no task sorts a hub alone.
    """

    #: Accounts of a frontier that are named in the filter, so that their buckets are known before reading; more are joined.
    NAMED = 500

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def build(cls, edges: DataFrame, *, buckets: int = 64, slices: int = 4, location: str | None = None) -> LedgerIndex:
        spark, table = edges.sparkSession, f"ledger_index_{uuid.uuid4().hex}"
        ends = both_ends(edges.select("tx_id", "src", "dst", "amount", "us", "cb"))
        other = F.when(F.col("out") == 1, F.col("dst")).otherwise(F.col("src")).alias("other")
        rows = ends.select(F.col("account_id").alias("account"), other, "out", "us", "tx_id", "src", "dst", "amount", "cb").where("account is not null")
        dealt = rows.repartition(F.pmod(F.hash("account"), F.lit(buckets)), F.pmod(F.xxhash64("tx_id", "us"), F.lit(slices)))
        path = location or f"{shared_dir(spark)}/{table}"
        dealt.write.format("parquet").bucketBy(buckets, "account").sortBy("account", "us", "tx_id").option("path", path).saveAsTable(table)
        return cls(spark, table)

    @classmethod
    def open(cls, spark: SparkSession, location: str, buckets: int = 64) -> LedgerIndex:
        """An index that another session built, with the number of buckets it was built with."""
        table = f"ledger_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {table} ({COLUMNS}) USING parquet CLUSTERED BY (account) SORTED BY (account, us, tx_id) INTO {buckets} BUCKETS LOCATION '{location}'")
        return cls(spark, table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def of(self, account: str) -> DataFrame:
        """The account's rows, one for each end that it is: a transaction to itself has two."""
        return self.rows().where(F.col("account") == account)

    def near(self, accounts: DataFrame) -> DataFrame:
        """The rows of the accounts (k), a table of any size."""
        some = [r["k"] for r in accounts.select("k").where("k is not null").distinct().limit(self.NAMED + 1).collect()]
        if len(some) <= self.NAMED:
            return self.rows().where(F.col("account").isin(some)) if some else self.rows().where("false")
        return self.rows().join(accounts.select(F.col("k").alias("account")).distinct(), "account", "left_semi")

    def transactions(self, account: str, limit: int = 2500) -> DataFrame:
        """tx_id, src, dst, amount, us, cb: the account's first ``limit`` transactions by time and id."""
        once = self.of(account).where("out = 1 or not (src <=> dst)")
        return once.select("tx_id", "src", "dst", "amount", "us", "cb").orderBy("us", "tx_id").limit(limit)

    def path(self, account: str, limit: int = 100) -> DataFrame:
        """hop, account_id, amount: the account with its first amount, the receiver of the largest it sent, and who that one sent most to.

        Only the account's first ``limit`` transactions are looked at, for the second hop too. Amounts are whole numbers;
        a hop that isn't there has no row.
        """
        t = self.transactions(account, limit).cache()
        first = t.orderBy("us", "tx_id").limit(1).select(F.lit(0).alias("hop"), F.lit(account).alias("account_id"), "amount")
        one = t.where(F.col("src") == account).orderBy(F.desc("amount"), "us", "tx_id").limit(1).select(F.lit(1).alias("hop"), F.col("dst").alias("account_id"), "amount")
        two = t.join(one.select(F.col("account_id").alias("src")), "src", "left_semi").orderBy(F.desc("amount"), "us", "tx_id").limit(1)
        hops = first.unionByName(one).unionByName(two.select(F.lit(2).alias("hop"), F.col("dst").alias("account_id"), "amount"))
        return hops.select("hop", "account_id", F.col("amount").cast("long").alias("amount"))

    def links(self, account: str, limit: int = 200) -> DataFrame:
        """src, dst, us, amount, role_source, role_target of the first ``limit`` links within two steps, either direction; parallel links of one time are one."""
        mine = self.of(account)
        around = mine.where(F.col("other") != account).select(F.col("other").alias("k")).distinct()
        far = self.near(around)
        rows = mine.select("src", "dst", "us", "amount").unionByName(far.select("src", "dst", "us", "amount"))
        rows = rows.groupBy("src", "dst", "us").agg(F.min("amount").alias("amount"))
        for c in ("src", "dst"):
            rows = rows.join(around.select(F.col("k").alias(c), F.lit(True).alias(f"{c}_near")), c, "left")
        role = lambda c: F.when(F.col(c) == account, "target").when(F.col(f"{c}_near"), "intermediary").otherwise("destination")
        return rows.select("src", "dst", "us", "amount", role("src").alias("role_source"), role("dst").alias("role_target")).orderBy("us", "src", "dst").limit(limit)

    def subgraph(self, account: str, accounts: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        """(nodes: id, name, bank, role; links: source, target, amount, us) of the two-step neighbourhood; names come from the register."""
        links = self.links(account, limit)
        ends = links.select(F.explode(F.expr("array(struct(src as id, role_source as role), struct(dst as id, role_target as role))")).alias("x")).select("x.*").distinct()
        known = accounts.select(F.col("account_id").alias("id"), "name", F.col("institution").alias("bank"))
        nodes = ends.join(known, "id", "left").select("id", F.coalesce("name", F.lit("Unknown Entity")).alias("name"), F.coalesce("bank", F.lit("N/A")).alias("bank"), "role")
        return nodes, links.select(F.col("src").alias("source"), F.col("dst").alias("target"), "amount", "us")

    def within(self, account: str, hops: int = 2) -> DataFrame:
        """tx_id, src, dst, amount, us, cb: transactions among all accounts within ``hops`` steps; each step reads the frontier's buckets."""
        seen = self.spark.createDataFrame([(account,)], "k string")
        frontier = seen
        for _ in range(hops):
            frontier = self.near(frontier).select(F.col("other").alias("k")).distinct().join(seen, "k", "left_anti")
            seen = seen.unionByName(frontier).distinct()
        sent = self.near(seen).where("out = 1")
        return sent.join(seen.withColumnRenamed("k", "dst"), "dst", "left_semi").select("tx_id", "src", "dst", "amount", "us", "cb")
