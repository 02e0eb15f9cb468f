"""Queries of the training-data operators, by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .decontaminate import contained_items
from .filter_audit import audit
from .line_dedup import drop_common_lines
from .mixing import mix
from .ngram_join import jaccard_components
from .oracles import ORACLES  # noqa: F401
from .pii import KINDS as PII_KINDS
from .pieces import decode_pieces, encode_pieces
from .pii import pseudonymise
from .quality import quality_rules
from .secrets import secret_scan
from .suffix_dedup import remove_repeats
from .token_shards import shard_rows, write_shards
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("row.doc_id", "source", "block", "slot", "place")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(_table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", sha, "spans", "n_live", "n_copied", "most_repos")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "n_shingles", "n_found")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark, write_shards(_table(spark, sf_dir, "documents")))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(_table(spark, sf_dir, "documents"), key="sievemark")
    return out.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in PII_KINDS), "n_replaced", "text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(_table(spark, sf_dir, "pages"), min_payload=0)
    ids = (F.when(F.col(c) != "null", F.col(c).cast("long")).alias(c) for c in ("page_id", "refers_to"))
    page, refers = ids
    return out.select(page, "payload_bytes", "payload_digest", "record_type", refers, "url_key")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *counts, "base_failed", "kept")


#: Vocabularies of the queries; the operators take their paths as parameters.
BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), PIECES), PIECES)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokenizers(_table(spark, sf_dir, "documents"), BYTES, PIECES)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_token_shards": op7_token_shards,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
