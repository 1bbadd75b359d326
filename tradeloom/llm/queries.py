"""The registered queries of this subpackage and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .centroid_clusters import cluster_vectors
from .decontaminate import contamination
from .filter_audit import filter_interactions
from .html_extract import extract_main_text
from .langid import identify
from .licenses import scan_licenses
from .ngram_join import ngram_jaccard
from .packing import pack
from .quality import BOILERPLATE, CLOSERS, END_MARKS, LineRules, quality_rules
from .secrets import find_secrets
from .sharding import minimax_shards
from .shared import table
from .substring_dedup import dedup_substrings
from .toxicity import toxicity

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"), shards=24)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scans": op2_secret_scans,
    "op3_language_id": op3_language_id,
    "op4_license_scans": op4_license_scans,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_clusters": op13_centroid_clusters,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op6_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op9_quality_rules": oracles.quality_rules(LineRules(), BOILERPLATE, END_MARKS, CLOSERS),
    "op12_filter_audit": oracles.FILTER_INTERACTIONS,
    "op13_centroid_clusters": oracles.cluster_vectors(),
}
