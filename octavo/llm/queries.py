"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, packing, pii, quality_classifier, quality_rules, sharding, simhash, warc

#: Name of a vocabulary file of the installed public tokenizers.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), columns=["doc_id", "text"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digests(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "secrets", "n_spans")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE)).withColumnRenamed("id", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE)).withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = quality_classifier.good_labels(_table(spark, sf_dir, "labels"))
    found = quality_classifier.resample(_table(spark, sf_dir, "documents"), good, columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("score", 6).alias("score"), F.round("gumbel_key", 6).alias("gumbel_key"), "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_pii": op1_pii, "op2_bpe": op2_bpe, "op3_packing": op3_packing, "op4_quality": op4_quality, "op5_warc": op5_warc, "op6_sharding": op6_sharding, "op7_rules": op7_rules, "op8_simhash": op8_simhash, "op9_license": op9_license, "op10_exact_dedup": op10_exact_dedup}

SQL = {
    "op5_warc": r"""
        with t as (select page_id, coalesce(html, '') as p from pages),
        d as (select *, max(page_id) over (partition by p) as last, sha1(encode(p)) as h from t),
        b as (select *, array_to_string(list_transform(range(1, 41), lambda i:
              substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i::int, 1)) - 1)::int + 1, 4)), '') as bits from d)
        select page_id, octet_length(encode(p))::bigint as payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   list_sum(list_transform(range(0, 5), lambda j: substr(bits, (5 * i + j + 1)::int, 1)::int * (16 >> j::int)))::int + 1, 1)), '') as payload_digest,
               case when page_id = last then 'response' else 'revisit' end as record_type,
               case when page_id = last then null else last end as refers_to
        from b""",
    "op10_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
        from t window w as (partition by norm)""",
}
