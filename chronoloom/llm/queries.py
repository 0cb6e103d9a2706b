"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import (
    alignment,
    bpe,
    html,
    licenses,
    mixing,
    neighbours,
    packing,
    quality,
    resampling,
    sharding,
    simhash,
    suffixes,
    urls,
)
from chronoloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select(
        "doc_id", "fingerprint", "component_id"
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder)).select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken"
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(
        documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filtered(documents(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents lie in one directory per source and language."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scanned(documents(spark, folder), path)


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(documents(spark, folder, "pages"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeats_removed(documents(spark, folder), with_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(documents(spark, folder, "embeddings"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(documents(spark, folder))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Draw a quarter of the documents, those most like the benchmark's texts."""
    return resampling.resampled(
        documents(spark, folder), documents(spark, folder, "benchmark")
    )


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encoded(documents(spark, folder), vocabulary, public_tokenizers.PATTERN)
    return bpe.digests(ids, vocabulary)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = alignment.aligned(
        documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
        groups=False,
    )
    return alignment.scored(found).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def queries() -> dict[str, Query]:
    return {
        q.__name__: q
        for q in (
            op1_quality_rules, op2_simhash, op3_mixing, op4_packing, op5_url_filters,
            op6_license_scan, op7_html_extraction, op8_suffix_dedup, op9_nearest_neighbours,
            op10_sharding, op11_importance_resampling, op12_byte_bpe, op13_token_alignment,
        )
    }
