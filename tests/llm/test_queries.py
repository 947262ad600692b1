"""The opN_ queries on small tables: nulls in every column, repeated rows, empty and long texts, clashing extra columns; and on empty tables."""

import corpus_pipeline
import pytest

from ledgerlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The folder of the tables ``odd`` and ``empty``."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("tables")
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        key, body = t.columns[0], {"documents": "text", "pages": "html", "benchmark": "text"}.get(name)
        odd = t.unionByName(t.orderBy(key).limit(2))
        odd = odd.unionByName(t.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema]))
        if body:
            high = t.agg(F.max(key)).first()[0]
            more = [(high + 1, ""), (high + 2, None), (high + 3, "one and the same phrase of seven words " * 3000)] if isinstance(high, int) else []
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema if f.name not in (key, body)]
            if more:
                odd = odd.unionByName(spark.createDataFrame(more, f"k {t.schema[key].dataType.simpleString()}, b string").select(F.col("k").alias(key), F.col("b").alias(body), *rest))
        for extra in ("score", "id", "th", "blk", "class_id", "n_tokens"):
            odd = odd.withColumn(extra, F.lit("theirs"))
        odd.write.parquet(f"{root}/odd/{name}.parquet")
    return root


QUERIES = dict(queries.QUERIES, pipeline=corpus_pipeline.run)
#: Queries of one row per row of their table, with the column of its id.
WHOLE = {"op12_token_files": "doc_id", "op1_ngram_jaccard_join": "doc_id", "op2_token_counts": "doc_id", "op5_html_main_text": "page_id", "op7_lm_score": "doc_id", "op8_personal_data": "doc_id", "op10_quality_classifier": "doc_id"}


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows(spark, tables, name):
    rows = QUERIES[name](spark, f"{tables}/odd").collect()
    assert rows
    if name in WHOLE:
        of = "pages" if "page" in WHOLE[name] else "documents"
        ids = [r[0] for r in spark.read.parquet(f"{tables}/odd/{of}.parquet").select(WHOLE[name]).collect()]
        key = lambda x: (x is None, x or 0)
        assert sorted((r[WHOLE[name]] for r in rows), key=key) == sorted(ids, key=key)
    if name in ("op7_lm_score", "op10_quality_classifier"):
        assert all(r.held_out is not None and r.score == r.score for r in rows)
    if name.startswith("op6"):  # the phrase repeated thousands of times, in an item and in a document, is 8 windows
        long = max(r[0] for r in spark.read.parquet(f"{tables}/odd/documents.parquet").select("doc_id").collect() if r[0] is not None)
        assert [(r.n_windows, r.n_item_windows, r.reparameterised) for r in rows if r.doc_id == long] == [(8, 8, False)]
    if name.startswith("op9"):
        assert all(r.query_id is not None and r.query_id % 50 == 0 and 1 <= r["rank"] <= 5 for r in rows)
    if name == "pipeline":
        assert {"score", "id", "th", "blk", "class_id", "n_tokens"} <= set(rows[0].__fields__) and {r.score for r in rows} == {"theirs"}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, f"{tables}/empty").collect() == []
