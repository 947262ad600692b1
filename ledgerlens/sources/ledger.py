"""Ledgers: accounts and transactions from CSV, XML reports and the driver's tables, in one schema.

edges: tx_id, src, dst (string), amount (double), us (bigint microseconds, may be null), cb (int)
accounts: account_id, name, acct_type, branch, institution, risk_grade, pep_flag, sanctions_hit, tax_number
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCOUNT_DEFAULTS = {"name": "", "acct_type": "UNKNOWN", "branch": "UNKNOWN_BRANCH", "institution": "UNKNOWN_BANK", "risk_grade": "UNKNOWN", "pep_flag": 0, "sanctions_hit": 0, "tax_number": "", "is_person": True}


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Adds missing columns and fills nulls, once, at the edge of the engine."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def first_existing(df: DataFrame, names: list[str], default=None):
    """The first of the candidate columns that the table has."""
    return next((F.col(c) for c in names if c in df.columns), F.lit(default))


def normalise_accounts(df: DataFrame) -> DataFrame:
    df = with_defaults(df.withColumn("account_id", F.col("account_id").cast("string")), ACCOUNT_DEFAULTS)
    return df.withColumn("tax_number", F.regexp_replace(F.col("tax_number").cast("string"), r"\.0$", ""))


def places(df: DataFrame) -> list:
    """The banks and countries of both ends of a transaction table's rows, with what stands for missing ones."""
    out = []
    for side, name in (("src", "sender"), ("dst", "receiver")):
        bank = F.coalesce(first_existing(df, [f"{name}_institution"]).cast("string"), F.lit("UNKNOWN_BANK"))
        country = F.coalesce(first_existing(df, [f"{name.capitalize()}_bank_location"]).cast("string"), F.lit("NP"))
        out += [bank.alias(f"{side}_bank"), country.alias(f"{side}_country")]
    return out


def normalise_transactions(df: DataFrame, as_of: str | None = None, label=None, with_places: bool = False) -> DataFrame:
    """Rows of a transaction table as edges; a time that doesn't parse is null, one that is missing is ``as_of``. With ``label`` it comes along, as do both ends' banks and countries ``with_places``."""
    if {"Date", "Time"} <= set(df.columns):
        ts = F.expr("try_to_timestamp(concat_ws(' ', Date, Time))")
    else:
        ts = first_existing(df, ["datetime"], as_of).cast("timestamp")
    amount = F.coalesce(first_existing(df, ["amount_local_npr", "Amount"]).cast("double"), F.lit(0.0))
    tx_id = first_existing(df, ["tx_id"]) if "tx_id" in df.columns else F.xxhash64(*df.columns)
    return df.select(
        tx_id.cast("long").alias("tx_id"), F.col("Sender_account").cast("string").alias("src"), F.col("Receiver_account").cast("string").alias("dst"),
        amount.alias("amount"), F.unix_micros(ts).alias("us"), F.coalesce(first_existing(df, ["cross_border_flag"], 0).cast("int"), F.lit(0)).alias("cb"),
        *([label.cast("int").alias("label")] if label is not None else []), *(places(df) if with_places else []),
    )


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """The first path that exists, as strings unless a schema is given or types are to be inferred."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        at = fs(p)
        if at.getFileSystem(conf).exists(at):
            reader = spark.read.option("header", True).option("inferSchema", infer and schema is None)
            return (reader.schema(schema) if schema else reader).csv(p)
    raise FileNotFoundError(f"none of {paths}")


def transactions_of(df: DataFrame, account: str, limit: int = 2500) -> DataFrame:
    """An account's transactions, the first ``limit`` by time and id; the filter reaches the scan."""
    return df.where((F.col("src") == account) | (F.col("dst") == account)).orderBy("us", "tx_id").limit(limit)


_S = T.StringType()
PERSON = T.StructType([T.StructField(c, _S) for c in ("first_name", "last_name", "passport_number", "tax_number")])
PARTY = T.StructType([T.StructField("signatory", T.StructType([T.StructField("t_person", PERSON)]))])
REPORT = T.StructType([
    T.StructField("report_id", _S), T.StructField("reason", _S),
    T.StructField("transaction", T.StructType([
        T.StructField("t_from_my_client", T.StructType([T.StructField("from_account", PARTY), T.StructField("from_person", PERSON)])),
        T.StructField("t_to", T.StructType([T.StructField("to_account", PARTY), T.StructField("to_person", PERSON)])),
    ])),
])


def people(report: str = "r"):
    t = f"{report}.transaction"
    return F.expr(f"filter(array({t}.t_from_my_client.from_account.signatory.t_person, {t}.t_from_my_client.from_person, {t}.t_to.to_account.signatory.t_person, {t}.t_to.to_person), p -> p is not null)")


def entities(reports: DataFrame, file_name=None, found: str | None = None, narrative=None) -> DataFrame:
    """A row per person of each parsed report ``r``: report_id (or the file's name), names, tax number, narrative. Reports that don't parse have no people.

    ``found`` names a column of people found elsewhere in the report, ``narrative`` is what a report without a reason tells.
    """
    rid = F.coalesce(F.nullif(F.trim("r.report_id"), F.lit("")), file_name if file_name is not None else F.lit(""))
    told = F.coalesce(F.nullif(F.col("r.reason"), F.lit("")), narrative if narrative is not None else F.lit(""), F.lit(""))
    each = reports.select(rid.alias("report_id"), told.alias("narrative"), F.explode(F.col(found) if found else people()).alias("p"))
    return each.select("report_id", *[F.coalesce(F.trim(f"p.{c}"), F.lit("")).alias(c) for c in PERSON.names], "narrative")


def parsed_reports(texts: DataFrame) -> DataFrame:
    """Entities of XML texts (value, f: the file's name): every ``t_person`` at any depth and the parties named directly; a reason that is missing is the first text of over 150 characters."""
    each = texts.select("f", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<report\b[^>]*>.*?</report>"), F.lit(0))).alias("x"))
    person = PERSON.simpleString()
    r = each.select("f", "x", F.from_xml("x", REPORT.simpleString()).alias("r"), F.regexp_extract_all("x", F.lit(r"(?s)<t_person\b[^>]*>.*?</t_person>"), F.lit(0)).alias("parts"))
    inside = F.expr(f"transform(parts, t -> from_xml(t, '{person}'))")
    direct = F.expr("filter(array(r.transaction.t_from_my_client.from_person, r.transaction.t_to.to_person), p -> p.first_name is not null or p.last_name is not null)")
    rows = r.withColumn("people", F.concat(inside, F.coalesce(direct, F.expr(f"from_json('[]', 'array<{person}>')"))))
    long = F.regexp_extract("x", r">\s*([^<\s][^<]{149,}[^<\s])\s*<", 1)
    return entities(rows, F.col("f"), "people", long)


def plain_xml(text):
    """XML text without comments, and with CDATA as escaped text, so that tags in either are no tags."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.when(bare.contains("<![CDATA["), F.array_join(F.transform(F.split(bare, r"<!\[CDATA\["), lambda x, i: F.when(i == 0, x).otherwise(cdata(x))), "")).otherwise(bare)


def cdata(piece):
    """What follows the start of a CDATA section: its text escaped, and the rest."""
    inside = F.substring_index(piece, "]]>", 1)
    rest = F.substring(piece, F.length(inside) + 4, F.length(piece))
    return F.concat(F.replace(F.replace(inside, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), rest)


def read_reports(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Entities of a folder of XML files with any number of reports each; every value is read as text.

    Files are cut at the ends of reports while they are read, so a large file is read in splits and a row holds one report.
    Comments are left out and CDATA is text. A report that doesn't parse has no people but those whose own elements are whole.
    """
    texts = spark.read.option("lineSep", "</report>").option("pathGlobFilter", pattern).text(path)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.xml$", "").alias("f")
    return parsed_reports(texts.select(plain_xml(F.concat("value", F.lit("</report>"))).alias("value"), name).where(F.col("value").contains("<report")))


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """The first feature table that exists, in order of preference, with types inferred; a table of transactions is summed up by account."""
    df = read_csv(spark, list(paths), infer=True)
    if {"Sender_account", "Receiver_account"} <= set(df.columns):
        from ledgerlens.operators.learn import LABELS, account_table

        keyed = df if "tx_id" in df.columns else df.withColumn("tx_id", F.monotonically_increasing_id())
        return account_table(normalise_transactions(keyed, label=first_existing(keyed, list(LABELS), 0)), label="label")
    return df


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a dense ledger with exact times; no self-loops."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = int(ev.agg(F.max("user_id")).first()[0] or 0) + 1
    m = max(n - 1, 1)
    return ev.select(
        F.col("event_id").alias("tx_id"), F.col("user_id").cast("string").alias("src"), F.expr(f"cast((user_id + 1 + (event_id * 7919) % {m}) % {n} as string)").alias("dst"),
        F.col("value").alias("amount"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "purchase").cast("int").alias("cb"),
    )


def order_ledger(spark: SparkSession, sf_dir: str, with_places: bool = False) -> DataFrame:
    """Orders and their lines as a wide ledger of daily resolution, with self-loops and equal rows; ``with_places`` also each end's bank and country."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n = t("customer").count()
    rows = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    nation = t("customer").select("c_custkey", "c_nationkey")
    rows = rows.withColumn("to", F.expr(f"l_partkey % {n}"))
    rows = rows.join(nation.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("sn")), "o_custkey", "left").join(nation.select(F.col("c_custkey").alias("to"), F.col("c_nationkey").alias("rn")), "to", "left")
    return rows.select(
        F.xxhash64("o_orderkey", "l_partkey", "l_extendedprice", "l_shipdate").alias("tx_id"), F.col("o_custkey").cast("string").alias("src"), F.col("to").cast("string").alias("dst"),
        F.col("l_extendedprice").alias("amount"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.coalesce((F.col("sn") != F.col("rn")).cast("int"), F.lit(0)).alias("cb"),
        *([F.expr("concat('BANK', o_custkey % 5)").alias("src_bank"), F.expr("coalesce(concat('C', sn), 'NP')").alias("src_country"), F.expr("concat('BANK', to % 5)").alias("dst_bank"), F.expr("coalesce(concat('C', rn), 'NP')").alias("dst_country")] if with_places else []),
    )


def event_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register for the event ledger: every user, named after a part."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).alias("user_id"), F.col("p_name").alias("name"))
    # by its files' bytes a large part table might be broadcast
    a = ev.join(part.hint("merge"), "user_id", "left")
    return a.select(
        F.col("user_id").cast("string").alias("account_id"), F.coalesce("name", F.lit("")).alias("name"), F.when(F.col("user_id") % 2 == 0, "CURRENT").otherwise("SAVINGS").alias("acct_type"),
        F.expr("concat('BR', user_id % 7)").alias("branch"), F.expr("concat('BANK', user_id % 3)").alias("institution"), F.expr("cast(user_id * 37 as string)").alias("tax_number"),
    )


#: The two event tables in DuckDB.
EVENT_SQL = """
n AS (SELECT max(user_id) + 1 AS n FROM events),
e AS (SELECT event_id AS tx_id, CAST(user_id AS VARCHAR) AS src, CAST((user_id + 1 + (event_id * 7919) % (n.n - 1)) % n.n AS VARCHAR) AS dst,
             value AS amount, epoch_us(ts) AS us, CAST(event_type = 'purchase' AS INTEGER) AS cb FROM events, n),
a AS (SELECT CAST(u.user_id AS VARCHAR) AS account_id, coalesce(p_name, '') AS name, CASE WHEN u.user_id % 2 = 0 THEN 'CURRENT' ELSE 'SAVINGS' END AS acct_type,
             'BR' || (u.user_id % 7) AS branch, 'BANK' || (u.user_id % 3) AS institution, CAST(u.user_id * 37 AS VARCHAR) AS tax_number
      FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN part ON p_partkey = u.user_id + 1)
"""
