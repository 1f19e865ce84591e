from __future__ import annotations

import corpus_pipeline
from changeflow.llm import sampling
from changeflow.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count(), name
        assert all(r.n_chars == len(r.text) for r in docs.select("n_chars", "text").collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    back = sampling.decode_pieces(coded, tokenizer_file(corpus_pipeline.PIECES))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())


def test_stages_take_odd_and_no_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count()
