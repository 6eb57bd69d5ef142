"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import (
    audit, bpe, brown, forest, hilbert, host_rules, licenses, merkle, packing, piecewise, repeats, tables, url_aliases, weak_labels,
)

#: Where the public vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op10_host_rules")
def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_documents(tables.documents(spark, sf_dir))
    c, v = F.col("counts"), F.col("verdict")
    return judged.select(
        F.col("id").alias("doc_id"), c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
        c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        v["base_failed"].alias("base_failed"), v["kept"].alias("kept"), F.round(v["host_rate"], 6).alias("host_rate"),
        v["host_verdict"].alias("host_verdict"),
    )


@query("op3_weak_labels")
def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_labels.score_documents(tables.documents(spark, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), F.col("pattern").alias("votes"), F.round("score", 6).alias("score"), "kept")


@query("op4_lsh_forest")
def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = forest.near_groups(tables.documents(spark, sf_dir))
    return groups.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


@query("op9_best_fit")
def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op6_url_aliases")
def op6_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_aliases.judge(tables.read(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "alias_verdict")


@query("op7_hilbert")
def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard_documents(tables.documents(spark, sf_dir))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query("op2_piecewise")
def op2_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_documents(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(tables.documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


@query("op1_brown_classes")
def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = F.concat_ws("/", part("source"), part("lang"), part("doc_id"))
    return licenses.scan(tables.documents(spark, sf_dir), path).withColumnRenamed("id", "doc_id")


@query("op11_postorder_log", merkle.SQL)
def op11_postorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op12_run_length_index")
def op12_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op13_failing_ids", audit.SQL)
def op13_failing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(tables.documents(spark, sf_dir), tables.read(spark, sf_dir, "labels"))
