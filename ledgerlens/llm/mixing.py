"""Mixing sources to target weights by Poisson replication, in SQL functions alone.

Each source gets a mean repetition rate: its target share of the output over its share of the input. A
hash of seed and document id gives a uniform number, and the inverted Poisson distribution with that mean
turns it into a count of copies; documents are exploded by it and dealt out by another hash. Only per-source
sums are gathered, so a source with most of the rows costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, stored

ADDED = ("copy", "shuffle_key")


def rates(docs: DataFrame, *, source_col: str, text_col: str, weights: dict | None, temperature: float, growth: float) -> DataFrame:
    """``source, rate, cdf`` of every source; the null source is one of its own, repeated rows count as often as they come, an empty table has no sources."""
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("double")
    per = stored(docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(size).alias("size")), "mix-sources")
    if weights is None:
        want = F.pow("size", F.lit(temperature))
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        want = F.coalesce(F.try_element_at(F.create_map(*given), F.col("src")), F.lit(0.0)) if given else F.lit(0.0)
    sums = per.agg(F.sum(want), F.sum("size")).first()
    total, chars = (float(x or 0) for x in sums)
    rate = want / total * chars * growth / F.col("size") if total > 0 else F.lit(0.0)
    steps = F.expr("sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) as int))")
    # log-probabilities, so that large rates don't underflow
    walk = F.expr(
        "aggregate(steps, struct(array(exp(-rate)) as cdf, -rate as lp), (a, k) -> struct("
        "concat(a.cdf, array(element_at(a.cdf, -1) + exp(a.lp + ln(rate / k)))) as cdf, a.lp + ln(rate / k) as lp), a -> a.cdf)"
    )
    cdf = F.when(F.col("rate") > 0, walk).otherwise(F.array(F.lit(1.0)))
    return per.select("src", rate.alias("rate")).withColumn("steps", steps).select("src", "rate", cdf.alias("cdf"))


def uniform(seed: str, *parts):
    """52 bits of an md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict | None = None, *, temperature: float = 0.7, growth: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, one row per copy, with ``copy`` (from 0) and ``shuffle_key``, dealt globally by that key.

    ``weights`` maps sources to relative target weights by characters, sources it omits go; None gives each the
    power ``temperature`` of its size. ``growth`` is the output's size over the input's. A null source is a source;
    a null id draws by its text, equal rows draw alike; null and empty texts count one character. An empty table
    gives no rows. Columns of docs named ``copy`` or ``shuffle_key`` are replaced.
    """
    require(docs, id_col, source_col, text_col)
    docs = docs.drop(*ADDED)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    table = rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature, growth=growth)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    drawn = docs.alias("d").join(table.alias("r"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("r.src")))
    # the inverse: the smallest n whose cumulative probability exceeds u
    n = F.expr("size(filter(r.cdf, c -> c <= __u))")
    drawn = drawn.withColumn("__u", uniform(seed, F.coalesce(F.col(f"d.`{id_col}`").cast("string"), F.md5(F.col(f"d.`{text_col}`").cast("binary")), F.lit("null")))).withColumn("__n", n).where("__n > 0")
    copies = drawn.select(*names, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), key, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same in DuckDB, with the default parameters; {docs} is the input.
SQL = """
WITH d AS (SELECT * FROM {docs}),
s AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE size FROM d GROUP BY source),
r AS (SELECT source, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size rate FROM s),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) cdf
      FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) k FROM r)),
u AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(text), 'null') key,
             CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 u FROM d),
a AS (SELECT source, list(cdf ORDER BY k) l FROM c GROUP BY source),
n AS (SELECT u.*, len(list_filter(a.l, lambda x: x <= u.u)) n FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('mix-order|' || key || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(generate_series(0, n - 1)) copy FROM n WHERE n > 0)
"""
