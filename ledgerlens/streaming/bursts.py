"""Streaming forms of the temporal features, over a stream of edges with a timestamp column ``ts``."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_volumes(edges: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """account_id, window start, sent amount and count; rows later than ``late`` are dropped by the watermark."""
    w = edges.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("src").alias("account_id"))
    return w.agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).select("account_id", F.col("w.start").alias("start"), "amount", "n")


def sessions(edges: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of an account's sending without a gap."""
    s = edges.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), F.col("src").alias("account_id"))
    return s.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select("account_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "amount")


def running_intensity(edges: DataFrame, mu: float = 0.01, alpha: float = 0.5, beta: float = 1.0, *, late: str = "1 hour", idle_hours: float | None = None) -> DataFrame:
    """account_id, hawkes_intensity before the account's newest event: lambda <- mu + (lambda + alpha - mu) * exp(-beta * hours), kept per account.

    State is two numbers a key; rows of a micro-batch are taken in order of time, one older than the state counts as no time passed.
    With ``idle_hours`` an account without an event for so long, by the watermark of ``ts``, is forgotten and told with ``mu``, so that state holds the active accounts
    only (what is forgotten has decayed to exp(-beta * idle_hours)), and rows that come ``late`` or more after the newest time seen are dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"account_id": [key[0]], "hawkes_intensity": [mu]})
            return
        last, excited = state.get if state.exists else (None, 0.0)
        for pdf in batches:
            for us in sorted(pdf.us):
                hours = 0.0 if last is None else max(0.0, (us - last) / 3.6e9)
                excited = (excited + (alpha if last is not None else 0.0)) * math.exp(-beta * hours)
                last = us if last is None else max(last, us)
        state.update((last, excited))
        if idle_hours is not None:
            state.setTimeoutTimestamp(max(int(last / 1000 + idle_hours * 3.6e6), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"account_id": [key[0]], "hawkes_intensity": [mu + excited]})

    keyed, timeout = edges, GroupStateTimeout.NoTimeout
    if idle_hours is not None:
        keyed, timeout = edges.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    keyed = keyed.withColumnRenamed("src", "account_id")
    return keyed.groupBy("account_id").applyInPandasWithState(step, "account_id string, hawkes_intensity double", "last long, excited double", "update", timeout)


def ghost_flows(edges: DataFrame, *, tolerance: float = 0.05, seconds: int = 3600, late: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """cb_tx, dom_tx, sender, receiver, ts: cross-border and domestic transactions of a stream alike in amount and time, as the second of them comes.

    The stream is joined with itself on logarithmic buckets of the amount and an interval of time. The interval and the watermark bound the
    state: a row is kept until nothing within ``seconds`` can still come, and rows later than ``late`` are dropped. ``known`` is a table of pairs
    (u < v) of accounts that deal with each other, which are no ghosts; without it all pairs are told. Amounts must be positive.
    """
    width = -math.log(1 - tolerance)
    rows = edges.where("amount > 0").withWatermark("ts", late)
    side = lambda p, cb: rows.where(f"cb = {cb}").select(*[F.col(c).alias(f"{p}_{c}") for c in ("tx_id", "src", "dst", "amount", "ts")])
    bucket = lambda c: F.floor(F.ln(c) / width)
    a = side("a", 1).withColumn("a_b", F.explode(F.array(*[bucket("a_amount") + i for i in (-1, 0, 1)])))
    b = side("b", 0).withColumn("b_b", bucket("b_amount"))
    near = f"a_b = b_b and b_ts >= a_ts - interval {seconds} seconds and b_ts <= a_ts + interval {seconds} seconds"
    alike = f"b_amount >= a_amount * (1 - {tolerance}) and b_amount <= a_amount * (1 + {tolerance}) and a_src <> b_dst"
    p = a.join(b, F.expr(f"{near} and {alike}")).select(F.col("a_tx_id").alias("cb_tx"), F.col("b_tx_id").alias("dom_tx"), F.col("a_src").alias("sender"), F.col("b_dst").alias("receiver"), F.greatest("a_ts", "b_ts").alias("ts"))
    if known is None:
        return p
    met = known.select("u", "v").distinct().withColumn("met", F.lit(True))
    on = (F.least("sender", "receiver") == F.col("u")) & (F.greatest("sender", "receiver") == F.col("v"))
    return p.join(met, on, "left").where("met is null").select("cb_tx", "dom_tx", "sender", "receiver", "ts")
