"""The corpus pipeline: every stage does its work on all rows of its predecessor."""

import hashlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_operators import SCHEMA, plain_clean, plain_copies, plain_links, plain_repeats

import corpus_pipeline
from lodestone.llm import queries, temperature_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from lodestone.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "test"))
    return out


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_each_stage(spark, stages):
    docs, cleaned, single, cut, mixed, tokens = stages
    ruled = {r["doc_id"]: plain_clean(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {i: text for i, (text, _, _, kept) in ruled.items() if kept}
    classes = plain_links([(r["doc_id"], r["text"]) for r in cleaned.collect()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, least, _ in classes if i == least}
    want = {i: k.decode("utf-8", "ignore") for i, _, _, _, k in plain_repeats([(r["doc_id"], r["text"]) for r in single.collect()])}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t for i, t in want.items() if t}
    rows = [(r["doc_id"], r["source"], r["text"]) for r in cut.collect()]
    assert Counter(r["doc_id"] for r in mixed.collect()) == plain_copies(rows, corpus_pipeline.REPETITION, temperature_mix.BLOCKS)
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in tokens.collect():
        ids = piece.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(piece.decode(ids).encode()).hexdigest()
    assert tokens.count() == mixed.count()


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, "word " * 12 + "and others that follow in one long line of text here.", None, "s", 5), (2, "word " * 12 + "and others that follow in one long line of text here.", None, "s", 5)]
    rows += [(k, f"Sentence {k} has quite some words, all of them plain, and ends with {k * 7} here.", "en", "s", 1) for k in (5, 6, 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({n: F.lit(n) for n in ("copy", "whole", "last", "text_key", "grp", "size", "keeper", "carry", "kept", "tokens")})
    for empty in (False, True):
        out = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        assert (out.count() == 0) == empty and all(r["copy"] == "copy" and r["last"] == "last" for r in out.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == out.count()


def test_registered(spark):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert queries.op7_url_filter(spark, SF).where(F.col("verdict").isNull()).count() == 0
