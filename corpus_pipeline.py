"""From raw documents to shards: each stage takes what the one before it kept.

Stages take (spark, docs, sf_dir) and return a frame; all but the last return the columns of documents.

In every stage a null text counts as an empty one, whole texts of any length count, null and repeated doc_ids are allowed,
columns beyond those of documents go along (whatever their names), and an empty table stays empty. What repeats does
so until the second stage, which keeps one of each; the fourth repeats rows again, as the mix asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import mixing, near, quality, sharding
from basalt.llm.common import Workspace, table
from basalt.llm.decontaminate import Decontaminator


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees reject go. Equal texts go or stay together; without labels all stay (score 1/2)."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest doc_id (one row of it, should it repeat).

    Texts without words, null and empty ones too, are only copies of equal ones; of classes without any doc_id one row a text stays.
    """
    return near.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Empty texts and items, and an empty benchmark, hold none."""
    return Decontaminator(docs, table(spark, sf_dir, "benchmark")).clean(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row appears as often as the mix takes it: none, or up to three times. Null sources are one source; ties are drawn by hash."""
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there, with its text: what the shards' writers need.

    Rows that the mix repeats, and equal ids, get places of their own; null sources come last.
    """
    return sharding.placed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Boosted trees and the cube method are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
