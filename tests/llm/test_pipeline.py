"""The stages in order, each on all that the one before it kept."""

from __future__ import annotations

import corpus_pipeline
import pytest

import __spark_entry__
from sleuthframe.llm import bpe, contamination, language_id, near_dup, registry, repeats

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id for r in language_id.identify(docs, language_id.train(docs)).collect() if r.accepted}
    now = language_id.keep_identified(spark, docs, SF).toPandas()
    assert set(now.doc_id) == first and len(now) >= 0.8 * docs.count()
    one = spark.createDataFrame(now, docs.schema)
    gone = {r.doc_id for r in near_dup.groups(one).collect()}
    now = near_dup.drop_near_duplicates(spark, one, SF).toPandas()
    assert set(now.doc_id) == first - gone
    now = repeats.drop_repeats(spark, spark.createDataFrame(now, docs.schema), SF).toPandas()
    two = spark.createDataFrame(now, docs.schema)
    assert repeats.repeated_spans(two).count() == 0
    leaks = {r.doc_id for r in contamination.leaks(two, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    enc = bpe.encoding(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    want = {i: enc.encode_ordinary(t) for i, t in zip(now.doc_id, now.text) if i not in leaks}
    assert {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_and_take_odd_rows(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a short text in plain words", "en", None, 27), (2, "a short text in plain words", "en", None, 27)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    clash = odd.selectExpr("doc_id", "text as Text", "lang", "source as __UID", "n_chars", "1 as uid", "2 as key", "3 as __SPANS", "4 as tokens", "5 as C0", "6 as h", "7 as spans")
    for df in (odd, odd.limit(0), clash):
        got = stage(spark, df, SF)
        if k < 4:
            assert got.schema.simpleString() == df.schema.simpleString()
            assert got.count() <= df.count()
        else:
            assert got.count() == df.count() and got.columns == ["doc_id", "tokens", "n_tokens", "exact"]


def test_names():
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
