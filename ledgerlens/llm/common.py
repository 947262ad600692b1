"""Reading tables and cutting lineage, shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared import shared_dir as shared_dir
from ledgerlens.sources.shared import stored as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of an id written as text, modulo ``m``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def fits(df: DataFrame, row_bytes: str, most: int = 16_000_000) -> bool:
    """Whether the rows of ``df`` (cheap to read), at ``row_bytes`` (SQL) each, come to ``most`` bytes at most."""
    return (df.agg(F.sum(F.expr(f"cast({row_bytes} as long)"))).first()[0] or 0) <= most


def small_side(df: DataFrame, row_bytes: str, most: int = 16_000_000) -> DataFrame:
    """``df`` marked for broadcast if it ``fits``; a larger one is left to a shuffled join."""
    return F.broadcast(df) if fits(df, row_bytes, most) else df
