"""Benchmark decontamination by template canonicalisation, in SQL functions alone.

Texts become templates: numbers, units after numbers and names turn into typed placeholders, the rest into
lower-case words. Windows of template tokens are hashed and joined with the benchmark's; where the windows
have slots, stretches of an occurrence count in which each value of the item stands for one value, so that a re-parameterised
question matches and a chance likeness with clashing values doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import fits, require, small_side, stored

WINDOW = 8
#: Words taken as units when they follow a number, and titles that precede a name.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|l|ml|litres?|liters?|h|hours?|min|minutes?|s|sec|seconds?|days?|weeks?|years?|usd|eur|gbp|dollars?|euros?|cents?|mph|kmh|percent|degrees?"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Miss|Herr|Frau|Sr|Sra"
NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*+(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.? +\p{{Lu}}\p{{Ll}}+|(?<=[\p{{Ll}},;] )\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{0,3}})(?![\p{{L}}\p{{N}}])"


def tokens(text: Column, values: bool) -> Column:
    """Template tokens; with ``values`` a placeholder carries what it stands for, as in <num=12>."""
    put = "=$0" if values else ""
    s = F.translate(F.coalesce(text, F.lit("")), "<>\n\t\r", "     ")
    s = F.when(s.rlike(r"\p{Lu}\p{Ll}"), F.regexp_replace(s, NAME, f" <name{put}> ")).otherwise(s)
    s = F.when(s.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(s, NUMBER, f" <num{put}> "), rf"(?i)(<num[^>]*>) *({UNITS})(?![\p{{L}}\p{{N}}])", "$1 <unit" + ("=$2" if values else "") + "> ")).otherwise(s)
    return F.regexp_extract_all(F.lower(s), F.lit(r"<(?:num|name|unit)[^<>]*>|[\p{L}\p{M}\p{N}]++"), F.lit(0))


def windows(tok: str, w: int) -> str:
    """SQL for the hashes of all windows of ``w`` tokens, in order."""
    return f"case when size({tok}) >= {w} then transform(sequence(0, size({tok}) - {w}), i -> xxhash64({w}, slice({tok}, i + 1, {w}))) else array() end"


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, w: int) -> DataFrame:
    """Windows of every item with their slot values; an item shorter than ``w`` tokens is one window.

    Windows with fewer than four plain words say too little and are left out. An item of ``w`` tokens or more that has
    no others keeps those of three different tokens, marked ``exact``: they count with equal values only. Windows that
    an item repeats, values included, are one, at the first place: else a phrase said n times would meet itself n * n times.
    """
    items = bench.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.xxhash64(text_col).alias("th"), tokens(F.col(text_col), True).alias("tv"))
    items = items.withColumn("w", F.least(F.lit(w), F.size("tv"))).where("w > 0")
    items = stored(items, "decon-items")  # else Catalyst may put the tokenising into the lambda, once for every window
    items = items.withColumn("all", F.expr("transform(sequence(0, size(tv) - w), i -> struct(i as b_pos, slice(tv, i + 1, w) as win))"))
    items = items.withColumn("usable", F.expr("filter(all, x -> size(filter(x.win, t -> not startswith(t, '<'))) >= 4)"))
    items = items.withColumn("exact", F.expr("size(usable) = 0")).withColumn("keep", F.expr(f"case when not exact then usable when w >= {w} then filter(all, x -> size(array_distinct(x.win)) >= 3) end"))
    items = items.withColumn("n_item", F.expr("size(array_distinct(transform(keep, x -> xxhash64(x.win))))"))
    rows = items.select("item", "th", "w", "exact", "n_item", F.explode("keep").alias("x")).groupBy("item", "th", "w", "exact", "n_item", "x.win").agg(F.min("x.b_pos").alias("b_pos"))
    rows = rows.withColumn("template", F.expr("transform(win, t -> regexp_replace(t, '=.*', '>'))"))
    return rows.select("item", "w", "b_pos", F.expr("xxhash64(w, template)").alias("h"), "template", F.expr("transform(filter(win, t -> startswith(t, '<')), t -> regexp_replace(t, '^<[a-z]+=|>$', ''))").alias("b_slots"), "n_item", "exact")


def stretches(pairs: DataFrame) -> DataFrame:
    """The windows of each diagonal's longest stretch whose slots agree: with ``n`` windows, ``changed`` of them with other values; and ``run``.

    ``pairs`` has a row for each window of a document that is an item's (id, th, item, w, diagonal, b_pos, n_item), with its distinct slot
    values ``v`` of (b, d) and whether any differ (``new``). Windows of one diagonal are a stretch while each value of the item stands for one
    value. For each window ``cut`` is the last one before it with a value that clashes with its own or with one's between them, so the longest
    stretch that ends in a window starts after its cut. ``run`` is the longest row of tokens of windows that overlap or touch
    within any stretch.
    """
    of = ("id", "th", "item", "w", "diagonal")
    along = Window.partitionBy(*of).orderBy("b_pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("b_pos").over(along)
    rows = pairs.withColumns({"rn": F.row_number().over(along), "next": F.lead("b_pos").over(along), "seen": F.sum("new").over(so_far), "starts": F.when(before.isNull() | (F.col("b_pos") - before > F.col("w")), F.col("b_pos"))})
    rows = rows.withColumn("run_start", F.max("starts").over(so_far))
    value = Window.partitionBy(*of, "s.b").orderBy("rn")
    other = F.when(F.lag("s.d").over(value) != F.col("s.d"), F.lag(F.struct("rn", "next", "seen")).over(value))
    each = rows.select("*", F.explode_outer("v").alias("s")).withColumn("clash", F.max(other).over(value.rowsBetween(Window.unboundedPreceding, 0)))
    clash = each.groupBy(*of, "rn", "b_pos", "n_item", "next", "seen", "run_start").agg(F.max("clash").alias("clash"))
    line = Window.partitionBy(*of).orderBy("rn")
    cut = clash.withColumn("cut", F.max("clash").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.coalesce(F.col("cut.rn"), F.lit(0))
    told = cut.withColumns({
        "n": F.col("rn") - first, "changed": F.col("seen") - F.coalesce(F.col("cut.seen"), F.lit(0)), "length": F.col("b_pos") + F.col("w") - F.greatest("run_start", F.coalesce("cut.next", "run_start")),
    })
    whole = Window.partitionBy(*of)
    best = told.withColumns({"run": F.max("length").over(whole), "best": F.max(F.struct("n", (-F.col("changed")).alias("kept"), "rn")).over(whole)})
    inside = best.where("rn <= best.rn and rn > best.rn - best.n")
    return inside.select("id", "th", "item", "b_pos", "n_item", "run", F.col("best.n").alias("n"), (-F.col("best.kept")).alias("changed"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, min_share: float = 0.3, min_run: int = 32, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """``id, text_hash, item_id, n_windows, n_item_windows, share, reparameterised`` for each document and item that it holds.

    Windows count by occurrence, where document and item run side by side, and there in the longest stretch in which each slot value of
    the item stands for one value (``stretches``); what an item repeats word for word counts once. A pair counts when at least ``min_share`` of the item's usable windows match so, or ``min_run``
    tokens in a row. ``reparameterised`` is that of the occurrence of most windows. Null and empty texts hold nothing; a null item id or text is left
    out; repeated rows give one pair; extra columns are ignored; an empty table on either side gives no rows. Texts of any length are read
    whole; an item and a document that hold one template n and m times with other values meet in n * m windows.
    Documents are scanned once for matches and once more for the few that have any. The benchmark's windows are
    broadcast only up to ``broadcast_bytes`` of them and shuffled beyond that.
    """
    require(docs, id_col, text_col)
    require(bench, item_col, text_col)
    known = stored(benchmark_windows(bench, item_col, text_col, window).distinct(), "decon-windows")
    seen = known.agg(F.collect_set("w").alias("w")).first()  # widths: at most ``window`` of them
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    small = fits(known, "100 + octet_length(array_join(template, '        ')) + octet_length(array_join(b_slots, '        '))", broadcast_bytes)
    hint = F.broadcast if small else (lambda df: df)
    keys = hint(known.select("h").distinct())
    tok = base.where("text is not null").select("id", "th", tokens(F.col("text"), False).alias("tok"))
    arrays = [windows("tok", w) for w in sorted(seen["w"])] or ["array(cast(null as long))"]
    hit = tok.select("id", "th", F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("h")).join(keys, "h", "left_semi")
    found = stored(hit.select("id", "th").distinct(), "decon-found")  # documents with any matching window
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    again = base.where("text is not null").alias("a").join(found.alias("b"), same, "left_semi").dropDuplicates(["id", "th"]).select("id", "th", tokens(F.col("text"), True).alias("tv"))
    again = again.withColumn("tok", F.expr("transform(tv, t -> case when startswith(t, '<') then regexp_replace(t, '=.*', '>') else t end)"))
    per_w = [f"transform({windows('tok', w)}, (h, i) -> struct({w} as w, i as pos, h as h))" for w in sorted(seen["w"])] or ["array(struct(0 as w, 0 as pos, 0L as h))"]
    at = again.select("id", "th", "tv", "tok", F.explode(F.expr(f"concat({', '.join(per_w)})")).alias("x")).select("id", "th", "x.*", F.expr("slice(tv, x.pos + 1, x.w)").alias("win"), F.expr("slice(tok, x.pos + 1, x.w)").alias("template"))
    pairs = at.join(hint(known), ["h", "w", "template"])
    slots = F.expr("transform(filter(win, t -> startswith(t, '<')), t -> regexp_replace(t, '^<[a-z]+=|>$', ''))")
    pairs = pairs.withColumn("d_slots", slots).where("not exact or b_slots = d_slots")
    pairs = pairs.withColumn("v", F.array_distinct(F.arrays_zip(F.col("b_slots").alias("b"), F.col("d_slots").alias("d")))).where("size(v) = size(array_distinct(v.b))")
    pairs = pairs.select("id", "th", "item", "w", "b_pos", "n_item", (F.col("pos") - F.col("b_pos")).alias("diagonal"), "v", F.expr("int(exists(v, x -> x.b <> x.d))").alias("new"))
    out = stretches(pairs).groupBy("id", "th", "item").agg(
        F.count_distinct("b_pos").alias("n_windows"), F.max("n_item").alias("n_item_windows"), F.max("run").alias("run"), (F.max_by("changed", F.struct("n", -F.col("changed"))) > 0).alias("reparameterised")
    )
    out = out.withColumn("share", F.col("n_windows") / F.col("n_item_windows")).where(f"share >= {min_share} or run >= {min_run}")
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("item").alias(item_col), "n_windows", "n_item_windows", "share", "reparameterised")


def clean_documents(docs: DataFrame, pairs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged. ``pairs`` is a stored result, as it is measured; up to 16 MB of ids are broadcast.

    Null and empty texts hold none and stay, rows of one id stay or go by their text, an empty table stays empty."""
    bad = pairs.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__th")).distinct()
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    return docs.join(small_side(bad, "24 + coalesce(octet_length(cast(__id as string)), 0)"), on, "left_anti")
