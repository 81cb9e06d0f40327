"""From raw documents to token ids: each stage takes the documents that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.decontam import find_leaks
from voxframe.llm.langid import fit_languages, keep_languages
from voxframe.llm.ngramjoin import near_duplicates
from voxframe.llm.secrets import mask_secrets
from voxframe.llm.shared import Scratch
from voxframe.llm.wordbpe import bpe_encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; those without letters or unlike every language go."""
    return keep_languages(docs, fit_languages(docs))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.  Rows without an id stay.

    Rows that share the id that stays are one document only where their texts are equal too.
    """
    groups = near_duplicates(docs)
    keepers = Scratch(spark, "keepers").keep(
        groups.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct(), "ids"
    )
    kept = docs.join(keepers, docs["doc_id"] == keepers["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers, names or units.

    Each row is judged by its own text, also where it has no id or shares one.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(F.sha2("text", 256).alias("key"), "text")
    leaks = find_leaks(texts, benchmark, id_col="key").select(F.col("doc_id").alias("_leak")).distinct()
    leaks = Scratch(spark, "leaks").keep(leaks, "ids")
    return docs.join(leaks, F.sha2(docs["text"], 256) == leaks["_leak"], "left_anti")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of what they decode to."""
    import public_tokenizers

    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicate_groups),
    ("decontamination", benchmark_decontamination),
    ("secret_scan", secret_masking),
    ("bpe_codec", bpe_codec),
]

#: The stages sample, hash and tokenize in ways that SQL cannot express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
