"""A pipeline over documents: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its rows are written as Parquet and read
again by the next. All but the last return the columns of documents; the last returns the pieces and where they are packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, packing, pii, quality, simhash
from textloom.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the production policy passes."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, estimates and token merges are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written into the shared folder and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/textloom/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        made = stage(spark, rows, sf_dir)
        made.write.parquet(f"{folder}/{n}-{name}")
        rows = spark.read.schema(made.schema).parquet(f"{folder}/{n}-{name}")
    return rows
