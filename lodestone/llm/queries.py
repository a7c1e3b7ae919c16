"""The registered queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import image_copies, lsh_forest, piece_codec, quality_classifier, quality_rules, slot_shards, suffix_levels, temperature_mix, url_filter, warc_zst
from lodestone.llm.common import table

#: The rules that op7 applies.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
N_SHARDS = 24
REPETITION = 2.0


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_codec.digests(piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every 50th image (the query set), searched among all images."""
    vectors = table(spark, sf_dir, "embeddings")
    return image_copies.find_copies(image_copies.draw_media(vectors), image_copies.draw_media(vectors.where("vec_id % 50 = 0"), edit=True))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = slot_shards.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality_classifier.train(docs, labels.where(~held_out))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temperature_mix.mix(table(spark, sf_dir, "documents"), repetition=REPETITION)
    return rows.select("doc_id", "source", "copy", "mix_block", "mix_order")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_zst.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(
        warc_zst.record_key("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), warc_zst.record_key("refers_to")).try_cast("long").alias("refers_to"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_suffix_dedup, op3_image_copies, op4_sharding, op5_quality_classifier, op6_mixing, op7_url_filter, op8_warc, op9_jaccard_join, op10_quality_rules)}

ORACLE_SQL = {
    "op7_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
            END AS rule FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
}
