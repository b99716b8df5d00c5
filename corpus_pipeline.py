"""From raw documents to packed training sequences: quality rules, near dedup, substring dedup, packing.

Each stage works on all that its predecessor kept. run() writes every stage's rows as
Parquet to the folder that the cluster shares and reads them again, so a stage's lineage
never reaches back over another's. No stage caps or samples documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import fit, keep_good
from tidemark.llm.storage import written
from tidemark.llm.substring_dedup import substring_dedup

END_OF_TEXT = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned list rejects. The list is learned from the labelled documents among docs."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_duplicates(docs).where("keeps").select(docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 35 words or more from the texts; n_chars follows; white space elsewhere stays as it is. A document that loses all its words stays."""
    cut = substring_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into power-of-two sequences of token ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned list, weighted minhash classes or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
