"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-closed risk bands.
BANDS = ((0.25, "LOW"), (0.5, "ELEVATED"), (0.75, "HIGH"), (0.9, "SEVERE"))
TOP_BAND = "CRITICAL"


def money_sum(c: str) -> Column:
    """Sum that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(28,6)")).cast("double")


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(x: Column, y: Column, eps: float) -> Column:
    return x / (y + eps)


def risk_band(score: Column) -> Column:
    out = F.lit(TOP_BAND)
    for edge, name in reversed(BANDS):
        out = F.when(score <= edge, name).otherwise(out)
    return out


def phonetic(c: Column) -> Column:
    """Soundex of the letters alone; empty without letters."""
    letters = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def first_name(c: Column) -> Column:
    return F.coalesce(F.get(F.split(F.trim(c), r"\s+"), F.lit(0)), F.lit(""))


def last_name(c: Column) -> Column:
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def indel_ratio(a: str, b: str) -> Column:
    """2 * LCS / (len a + len b) by nested folds over the characters; two empty strings are alike."""
    lcs = (
        f"aggregate(filter(split({a}, ''), x -> x <> ''), array_repeat(0, length({b}) + 1), (r, x) -> aggregate(sequence(1, greatest(length({b}), 1)), array(0), "
        f"(q, j) -> concat(q, array(case when substring({b}, j, 1) = x then r[j - 1] + 1 else greatest(r[j], q[j - 1]) end))), r -> element_at(r, -1))"
    )
    return F.expr(f"case when length({a}) + length({b}) = 0 then 1D when length({a}) = 0 or length({b}) = 0 then 0D else 2D * {lcs} / (length({a}) + length({b})) end")


def weight(i: str, j: str, seed: float, scale: float) -> Column:
    """Closed-form projection weight, the same in every run and engine."""
    return F.sin(F.expr(f"12.9898D * {i} + 78.233D * {j} + {seed}D")) * scale


def sentence_case(c):
    """Underscores as spaces, the first letter upper case and the rest lower."""
    text = F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
