"""The opN_ queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import clusters, decontaminate, filter_audit, html_text, lm_score, mixing, ngram_join, passages, pii, quality, token_counts, token_files, topk
from ledgerlens.llm.common import crc_mod, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies (five-word shingles, similarity 0.8 or more) and its number of links."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every whole text."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every document that others hold too, with few changes."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by Poisson counts toward the sources' target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds, verbatim or with other numbers, names or units."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every whole text under a trigram model, and under single words."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every whole text."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest inner product for every row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a document's quality is labelled 1, from its whole text."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds from 40 centroids, with distances and the centroids' digests."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written to token files and read back: where they start, how many, and their crc32."""
    docs = table(spark, sf_dir, "documents")
    back = token_files.read_tokens(spark, token_files.write_tokens(docs, tokenizer("byte_bpe_50k.json")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in all 120 orders."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_token_counts, op3_substring_dedup, op4_source_mixing, op5_html_main_text, op6_benchmark_decontamination,
        op7_lm_score, op8_personal_data, op9_exact_top_k, op10_quality_classifier, op11_centroid_clusters, op12_token_files, op13_filter_audit,
    )
}

#: The exact search in SQL: integer inner products of every query against every other row.
TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r q, a.vec_id query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) r FROM s) WHERE r <= 5
"""

ORACLES: dict[str, str] = {
    "op4_source_mixing": mixing.SQL.format(docs="documents"),
    "op9_exact_top_k": TOP_K_SQL,
    "op11_centroid_clusters": clusters.sql(),
    "op13_filter_audit": filter_audit.SQL,
}
