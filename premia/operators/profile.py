"""Distributions of single columns: counts, shares and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.names import column

HISTOGRAM_BINS = 30


def level_distribution(df: DataFrame, col_name: str) -> DataFrame:
    """``(level, n, share)`` including the null level; shares are of all rows."""
    counts = df.groupBy(column(col_name).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # Counting rows reads no column, so it is cheaper than adding up the counts again.
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def value_counts(df: DataFrame, col_name: str) -> DataFrame:
    """Non-null levels, the most frequent first."""
    x = column(col_name)
    return (
        df.where(x.isNotNull())
        .groupBy(x.alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("level"))
    )


def histogram(df: DataFrame, col_name: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, lower, upper, n)`` over equal-width bins from minimum to maximum.

    The maximum belongs to the last bin; empty bins are left out; NaN counts as missing.
    """
    x = column(col_name).cast("double")
    present = df.select(F.when(~F.isnan(x), x).alias("x")).where(F.col("x").isNotNull())
    edges = present.agg(
        F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")
    ).scalar()
    lo, width = edges.getField("lo"), (edges.getField("hi") - edges.getField("lo")) / bins
    place = F.floor(F.try_divide(F.col("x") - lo, width)).cast("int")
    k = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
    return (
        present.groupBy(k.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("lower"),
            (lo + (F.col("bin") + 1) * width).alias("upper"),
            "n",
        )
    )


def column_profile(df: DataFrame, col_name: str) -> DataFrame:
    """Histogram of a number, or value counts of anything else."""
    kind = df.schema[col_name].dataType.typeName()
    if kind in ("float", "double", "integer", "long", "short", "byte"):
        return histogram(df, col_name)
    return value_counts(df, col_name)
