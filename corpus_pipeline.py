"""A training corpus from raw documents: quality rules, near duplicates, repeated substrings, mixing, tokens.

Each stage gets its predecessor's rows, written as Parquet and read again, so that a lost executor repeats one stage
at most.  A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lsh_forest, piece_codec, quality_rules, suffix_levels, temperature_mix
from lodestone.llm.common import fresh, materialize, table

#: No source is read more than so many times.
REPETITION = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    own_id, own_text = fresh(docs, "own_id", "own_text")
    found = lsh_forest.near_duplicates(docs, with_keeper=True)
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = found.where("keeper").select(known.alias(own_id), F.col("text_key").alias(own_text)).distinct()
    rows = docs.withColumns({own_id: known, own_text: F.xxhash64("text")}).join(kept, [own_id, own_text], "left_semi")
    return rows.dropDuplicates([own_id, own_text]).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat earlier text go (with characters that a cut would break); documents left without text go."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = suffix_levels.remove_repeats(docs, carry=others)
    out = out.select(*[F.col("carry")[c].alias(c) for c in others], F.col("kept_text").alias("text")).where("text <> ''")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to REPETITION times."""
    own = {c: fresh(docs, c)[0] for c in docs.columns if c.lower() in ("copy", "mix_block", "mix_order")}
    mixed = temperature_mix.mix(docs.withColumnsRenamed(own), repetition=REPETITION)
    return mixed.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    out = piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated substrings", repeated_substrings), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
