"""The pipeline on a small corpus: what goes, what stays, and that the stages' columns hold."""

import corpus_pipeline
import numpy as np

from ledgerlens.llm import ngram_join, pii

WORDS = ["".join(np.random.default_rng(5).choice(list("abcdefghijkl"), 6)) for _ in range(1)] + [f"w{i}x" for i in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_pipeline(spark, tmp_path):
    item = prose(30, 900)
    texts = [prose(60 + i % 40, i) if i % 4 else prose(60 + i % 40, i).upper().replace(" ", "!! ") for i in range(160)]
    texts += [texts[1], texts[1] + " tail", texts[2] + " " + item, texts[3] + " write to me@here.org", None, ""]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    docs, kept = d, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == d.columns
        docs.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {i for i in range(160) if i % 4}
    assert len(kept[0] & good) >= 0.95 * len(good) and len(kept[0] - good - {160, 161, 162, 163, 164, 165}) <= 2
    classes = {r.doc_id: r.class_id for r in ngram_join.join(spark.read.parquet(str(tmp_path / "stage0"))).collect()}
    assert kept[1] == {i for i, c in classes.items() if i == c} and not {160, 161} & kept[1]
    assert kept[2] == kept[1] - {162} and kept[3] == kept[2]
    assert pii.digest(pii.detect(spark.read.parquet(str(tmp_path / "stage3")))).agg({"n_email": "sum"}).first()[0] == 0
    assert kept[4] <= kept[3] and {"copy", "shuffle_key"} <= set(docs.columns)
