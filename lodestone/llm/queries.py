"""One query for each operator, with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, oracles
from .common import read
from .decontamination import find_contained
from .hard_negatives import mine_hard_negatives
from .html_extraction import extract_articles
from .line_dedup import dropped_lines
from .lm_scoring import score_documents
from .mixing import mix_to_weights
from .ngram_join import ngram_links
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .sharding import shard_by_bytes
from .vector_codes import codebooks_digest, compress
from .warc import archive, read_warc, resolve_revisits


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_to_weights(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = resolve_revisits(read_warc(spark, where))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    digits = F.lower(F.hex("code"))
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_entropy_mixing": op1_entropy_mixing,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_decontamination": op3_decontamination,
        "op4_html_extraction": op4_html_extraction,
        "op5_quality_rules": op5_quality_rules,
        "op6_warc": op6_warc,
        "op7_secrets": op7_secrets,
        "op8_ngram_join": op8_ngram_join,
        "op9_sharding": op9_sharding,
        "op10_line_dedup": op10_line_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
