"""The numbered queries and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base_queries
from .decontam import find_leaks
from .langid import fit_languages, identify_languages
from .licenses import scan_licenses
from .manifest import MANIFEST_SQL, tampered_manifest
from .media import encode_media, media_features
from .mixing import MIX_SQL, mix_sources
from .ngramjoin import near_duplicates
from .periodic import periodic_runs, plant_repeats, run_digests
from .secrets import secret_digests
from .suffixdedup import remove_repeats
from .tokencount import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .wordbpe import bpe_digests


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(_documents(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return score_toxicity(documents, fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return identify_languages(documents, fit_languages(documents))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(plant_repeats(_documents(spark, sf_dir))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(_documents(spark, sf_dir))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        f.__name__: f
        for f in (
            op1_license_scan, op2_bpe_codec, op3_ngram_jaccard, op4_suffix_dedup, op5_media_columns, op6_token_counts, op7_toxicity,
            op8_language_id, op9_decontamination, op10_secret_scan, op11_periodic_runs, op12_merkle_manifest, op13_source_mix,
        )
    }
    return own | base_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": MANIFEST_SQL, "op13_source_mix": MIX_SQL} | base_queries.ORACLES
