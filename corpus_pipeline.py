"""From raw documents to packed sequences, in four stages.

Each stage reads what the one before it wrote: documents of low quality go, then those that
fail the rules of text and host, then all but one of each group of near-duplicates (word
5-shingles, likeness 0.8 or more), and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from premia.llm import forest, host_rules, packing, tables, weak_labels
from premia.session import ScratchTable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.keep_good(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("pack", pack)]

#: SQL cannot express the learnt scorer, nor the forest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = tables.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        table = ScratchTable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            # Nothing reads a stage's input once its output is written.
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
