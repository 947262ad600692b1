"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last adds ``copy`` and
``shuffle_key``. A stage sees only what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, mixing, ngram_join, pii, quality
from ledgerlens.llm.common import stored, table

#: A document goes when the classifier finds it likelier bad than good.
LEAST_QUALITY = 0.5


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no column bears yet."""
    low = {c.lower() for c in taken}
    return next(n for n in (wanted, *(f"{wanted}_{i}" for i in range(len(low)))) if n.lower() not in low)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score ``LEAST_QUALITY`` or more, by a classifier trained on ``labels``; columns as they come.

    Null and empty texts have the score of the empty text, null ids and repeated rows stay or go by their text, extra
    columns of any name are kept, an empty table stays empty.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    rest, score = tuple(c for c in docs.columns if c != "doc_id"), free_name(docs.columns, "score")
    scored = quality.quality_scores(docs, weights, keep=rest, score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike to 0.8 or more: that of least id. Texts without words and null ids are alike to nothing and stay; of repeated rows one stays; columns as they come."""
    return ngram_join.one_of_each(docs, stored(ngram_join.join(docs), "pipeline-classes"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of ``benchmark``; null and empty texts, null ids and repeated rows among them stay; an empty benchmark drops nothing; columns as they come."""
    return decontaminate.clean_documents(docs, stored(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), "pipeline-leaks"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text replaced by its kind, and ``n_chars``, where there is one, counted anew; null and empty texts stay as they are, as do null ids, repeated rows and other columns."""
    new = pii.redact(docs, stored(pii.detect(docs), "pipeline-spans"))
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else new


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out by Poisson counts toward the sources' target weights, in shuffled order; see ``mixing.mix`` for nulls, repeats and clashing names."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("personal data", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express the first two stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}")
    return docs
