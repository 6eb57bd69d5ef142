"""Input tables, shared intermediate tables, and words as column expressions."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import ScratchTable

# The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so lineage ends here."""
    return ScratchTable(df, label).df


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose DataFrames are gone.

    Spark does so when the driver's JVM collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between white space, as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def own_columns(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of ``df`` (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
