"""One query per operator, over its whole table, in the form of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import (
    bpe,
    conversation_trie,
    decontamination,
    embedding_duplicates,
    html_extraction,
    language_model,
    near_duplicates,
    quality_classifier,
    quality_rules,
    secrets,
    spelling_variants,
    url_filters,
    warc,
)

#: The public tokenizer that the encoding query uses.
TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_read(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, the part of the URL filters that SQL can express."""
    return url_filters.ruled(_read(spark, sf_dir, "pages"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules.quality_verdicts(docs, carry=["doc_id"])
    return out.select(
        "row.doc_id",
        "stats.n_words",
        "stats.word_chars",
        "stats.n_symbols",
        "stats.n_dup_lines",
        "stats.n_repeat_words",
        "base_failed",
        "kept",
    )


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, carry=["doc_id"])
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), bpe.load(tokenizer_path()))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_read(spark, sf_dir, "documents"))


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.near_vectors(_read(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """Place of the tokenizer file, which the installed package names."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_url_filters": op6_url_filters,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_language_model": op9_language_model,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_duplicates": op13_embedding_duplicates,
    "url_rules": url_rules,
}
