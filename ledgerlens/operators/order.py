"""Sums, places and quantiles in a total order, without a window over the whole table.

Rows are dealt in ranges of their order, so that a task holds one range, each range's sums are one row, and what lies
before a range is added to the sums within it. The driver sees one row a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.shared import stored


def sums_before(df: DataFrame, order: list, values: dict) -> tuple[DataFrame, dict[str, float]]:
    """The rows with, for each name in ``values``, the sum of its column over all rows before; and the sums over all rows.

    ``order`` sorts the rows and should leave no ties that matter; a null value counts as 0. An empty table has no rows and sums
    of 0. The table is stored once, as dealt, since the ranges must not change between its sums and its rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumns({f"_v_{n}": c for n, c in values.items()}).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "order")
    per = dealt.groupBy("_range").agg(*[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(n) for n in values]).collect()
    total, rows = dict.fromkeys(values, 0), []
    for r in sorted(per, key=lambda r: r["_range"]):
        rows.append((r["_range"], *total.values()))
        total = {n: s + r[n] for n, s in total.items()}
    kinds = {n: "double" if dealt.schema[f"_v_{n}"].dataType.typeName() in ("double", "float") else "long" for n in values}
    rows = [(r[0], *(float(x) if kinds[n] == "double" else int(x) for n, x in zip(values, r[1:]))) for r in rows]
    starts = df.sparkSession.createDataFrame(rows, "_range int, " + ", ".join(f"_b_{n} {kinds[n]}" for n in values))
    ahead = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(ahead), F.lit(0))).alias(n) for n in values]), total


def quantiles(df: DataFrame, value: str, at: list[float]) -> list[float] | None:
    """Exact quantiles of a column, linear between neighbours; None if it has no value. Equal values are one row while they are placed."""
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed, total = sums_before(per, [F.col("v")], {"before": F.col("c")})
    if not total["before"]:
        return None
    places = [q * (total["before"] - 1) for q in at]
    wanted = sorted({n for p in places for n in (math.floor(p), math.ceil(p))})
    hit = F.array(*[F.lit(n).cast("long") for n in wanted])
    found = placed.select("v", F.explode(F.filter(hit, lambda n: (n >= F.col("before")) & (n < F.col("before") + F.col("c")))).alias("n")).collect()
    v = {r["n"]: r["v"] for r in found}
    return [(math.ceil(p) - p) * v[math.floor(p)] + (p - math.floor(p)) * v[math.ceil(p)] if p != math.floor(p) else v[int(p)] for p in places]
