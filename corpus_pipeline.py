"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding. Each stage reads its predecessor's table.

The stages take any docs with the columns of documents (doc_id, text, lang, source, n_chars) and others. Null and
empty texts don't pass the quality rules; later stages accept them as their operators say. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxspark.llm import bpe, jaccard_join, mixing, pii, quality
from fluxspark.llm.shared import content_key, told_apart, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trusted-text ratio keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels).filter("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id."""
    found = jaccard_join.near_duplicates(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"))
    kept = found.filter("kept").groupBy(content_key(F.col("doc_id"), F.col("tkey")).alias("key")).agg(F.count("*").alias("n"))
    keyed = docs.withColumn("__tkey", F.md5("text"))
    return told_apart(keyed, "doc_id", "__tkey").join(kept, "key").filter("copy <= n").select("row.*").drop("__tkey")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeats included."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of ids and decoded text of every document."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_file("word_bpe_49k.json"), back="decoded", packed=True)
    return coded.select(
        "doc_id", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: SQL can't express the trained ratio, the pattern graph or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
