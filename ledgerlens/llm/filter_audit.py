"""What each filter removes in every order of a filter chain.

Each document becomes a mask of the filters that it fails; documents are counted by part, mask and label, and only these
cells, 2**filters a part, are looked at afterwards. All orders are visited by swaps of neighbours, so that a step of the
walk changes two places of the chain and only those are counted anew; an order's removals are added to the filters'
sums along the walk, which makes the Shapley values.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require

#: White space between words, and the signs that filter D looks for.
GAP, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def swaps(n: int) -> Iterator[int]:
    """Places i whose swap with i + 1 leads through all orders of ``n`` things, each once (plain changes)."""
    place, way = list(range(n)), [-1] * n  # of each thing
    at = list(range(n))
    while True:
        movable = [x for x in range(n) if 0 <= (to := place[x] + way[x]) < n and at[to] < x]
        if not movable:
            return
        x = max(movable)
        i, j = place[x], place[x] + way[x]
        other = at[j]
        at[i], at[j], place[x], place[other] = other, x, j, i
        for bigger in range(x + 1, n):
            way[bigger] = -way[bigger]
        yield min(i, j)


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(orders, counts of each order and step, sums of each filter's removals) for cells [mask, (all, good, toxic)].

    Counts are kept, removed, redundant, good lost, toxic lost.
    """
    mask = np.arange(1 << n)
    fails = [(mask >> f & 1).astype(bool) for f in range(n)]
    total = cells.sum(0)

    def step(before: int, f: int) -> np.ndarray:
        """Counts of the step of filter ``f`` after the filters in ``before``, but for what is kept."""
        gone = (mask & before) != 0
        lost = cells[fails[f] & ~gone].sum(0)
        return np.array([0, lost[0], cells[fails[f] & gone, 0].sum(), lost[1], lost[2]], np.int64)

    order = list(range(n))
    now, before = [], 0
    for f in order:
        now.append(step(before, f))
        before |= 1 << f
    orders, found, shapley = [], [], np.zeros(n, np.int64)

    def visit() -> None:
        table = np.stack(now)
        table[:, 0] = total[0] - np.cumsum(table[:, 1])
        shapley[order] += table[:, 1]
        orders.append(tuple(order))
        found.append(table)

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        now[i], now[i + 1] = step(before, order[i]), step(before | 1 << order[i], order[i + 1])
        visit()
    assert len(orders) == factorial(n)
    return orders, np.stack(found), shapley


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` and counts, from cells ``part, mask, n, good, toxic``: bit i of the mask is filter i of ``letters``.

    A part is walked by itself; it has one row of 3 * 2**filters numbers, whatever the number of documents.
    """
    n = len(letters)
    size = 1 << n
    sums = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(size) for c in ("n", "good", "toxic")]
    one = cells.groupBy("part").agg(F.array(*sums).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                table = np.array(flat, np.int64).reshape(size, 3)
                orders, found, shapley = walk(table, n)
                only = table[1 << np.arange(n), 0]
                f = np.array(orders).reshape(-1)
                words = ["".join(letters[x] for x in o) for o in orders]
                flat = found.reshape(-1, 5)
                out = {"part": pa.array([part] * len(f)), "filter_order": pa.array(np.repeat(words, n)), "step": pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32())}
                values = (flat[:, 0], flat[:, 1], flat[:, 2], only[f], flat[:, 3], flat[:, 4], shapley[f])
                yield pa.record_batch(out | {c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, values)})

    return one.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def document_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by which of the filters A to E they fail.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % capital letters A-Z; D: holds a sign of ``#$%&*|``; E: a row
    of smaller id has the same text. No row is joined to its copies: rows are counted by id first, then by text, where a text
    keeps its least id and how many rows have that one. A null id is compared with nothing, so passes E and fails no other row; rows of one id pass or fail E
    together. A null text is empty, a null part the empty string. A document is good or toxic if any label row of its id says so.
    """
    require(docs, id_col, text_col, part_col)
    require(labels, "doc_id", "quality", "toxic")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words = words.select("id", "part", "t", F.filter(F.split("t", GAP), lambda w: w != "").alias("w"))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    tests = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length("t"), F.col("t").rlike(SIGNS))
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    rows = words.select("id", "part", F.sha2("t", 256).alias("h"), mask.alias("mask")).groupBy("id", "part", "h", "mask").agg(F.count("*").alias("n"))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id find no label: dealt by their text, they don't meet in one task
    far = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h"), F.lit(1024))).otherwise(F.lit(0))
    known = rows.withColumn("far", far).join(told.withColumn("far", F.lit(0).cast("long")), ["id", "far"], "left")
    same = ("h", "mask", "part", "good", "toxic")
    known = known.select("id", "n", "h", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    texts = known.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("free"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    )
    least = texts.groupBy("h").agg(F.min("low").alias("least"), F.collect_list(F.struct("mask", "part", "good", "toxic", "n", "low", "free", F.col("first.n").alias("at_low"))).alias("x"))
    each = least.select("least", F.explode("x").alias("x")).select("least", "x.*")
    passing = F.col("free") + F.when(F.col("low") == F.col("least"), F.coalesce("at_low", F.lit(0))).otherwise(0)
    both = each.withColumn("ok", passing).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("ok").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("ok")).alias("n")))).alias("y"))
    return both.select("part", "y.mask", "y.n", (F.col("good") * F.col("y.n")).alias("good"), (F.col("toxic") * F.col("y.n")).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of filters A to E in all 120 orders, for every part.

    Zeros are included; an empty table has no part, so no rows; texts of any length are read whole; see ``document_cells`` for
    nulls, repeated rows and ties. Other columns are ignored whatever their names.
    """
    return audit(document_cells(docs, labels, **columns), "ABCDE")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) good, max(CAST(toxic = 1 AS INTEGER)) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, len(w) < 100 "A", 100 * len(list_distinct(w)) < 80 * len(w) "B", 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) "C", regexp_matches(t, '[#$%&*|]') "D",
   coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) "E", coalesce(good, 0) good, coalesce(toxic, 0) toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: ["A", "B", "C", "D", "E"][i]) f, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x), o AS (SELECT a.x || b.x || c.x || d.x || e.x o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, o, k, substr(o, k, 1) f, string_split(substr(o, 1, k - 1), '') b FROM o, range(1, 6) r(k), (SELECT DISTINCT part FROM c)),
q AS (SELECT s.part, o, k, s.f, sum(CASE WHEN NOT list_has_any(c.f, list_append(b, s.f)) THEN n ELSE 0 END) kept, sum(CASE WHEN list_contains(c.f, s.f) AND NOT list_has_any(c.f, b) THEN n ELSE 0 END) removed,
  sum(CASE WHEN list_contains(c.f, s.f) AND list_has_any(c.f, b) THEN n ELSE 0 END) redundant, sum(CASE WHEN c.f = [s.f] THEN n ELSE 0 END) unique_fails,
  sum(CASE WHEN list_contains(c.f, s.f) AND NOT list_has_any(c.f, b) THEN good ELSE 0 END) good_lost, sum(CASE WHEN list_contains(c.f, s.f) AND NOT list_has_any(c.f, b) THEN toxic ELSE 0 END) toxic_lost FROM s JOIN c ON c.part = s.part GROUP BY ALL)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM q
"""
