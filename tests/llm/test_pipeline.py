"""Stages of the pipeline on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first {passage} end"), (2, f"second\n{passage} other end"), (3, None), (4, ""), (None, f"no id {passage}"), (5, "short text"), (5, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns of other kinds, and with names that operators use
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df.withColumns({
        "lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "extra": F.array(F.lit(1), F.lit(2)),
        "n_words": F.lit("x"), "kept": F.lit(True), "a.b": F.col("doc_id") * 10, "_key": F.lit("k"), "shard": F.lit(1.5),
    }).write.parquet(path)
    # stages read what was written
    return spark.read.parquet(path)


def test_substring_stage_carries_all_columns(spark, docs):
    out = corpus_pipeline.substring_dedup(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    assert len(got) == 7
    second = next(r for r in got if r.doc_id == 2)
    assert "p30" not in second.text and second.text.split() == ["second", "other", "end"] and second.n_chars == len(second.text)
    assert second["a.b"] == 20 and second.extra == [1, 2] and second.n_words == "x"
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id in (1, 4, 5)) == sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in (1, 4, 5))
    assert corpus_pipeline.substring_dedup(spark, docs.where("false"), "").collect() == []


def test_near_duplicate_stage_keeps_the_least_id(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(9, text), (7, text), (8, text + " more"), (6, "quite another text of more than five words"), (None, text)], "doc_id long, text string")
    rows = rows.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c not in ("doc_id", "text")})
    out = corpus_pipeline.near_duplicates(spark, rows.select(*(F.col(f"`{c}`") for c in docs.columns)), "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["6", "7", "None"]
