"""Portfolios and rate tables as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.names import column
from premia.functions.split import hash32


def read_portfolio(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A Parquet or CSV portfolio; the format follows the file ending unless given.

    A CSV without a schema is read twice, the first time to infer types.
    """
    if format is None:
        format = "csv" if path.lower().rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    if format == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if format != "csv":
        raise ValueError("format must be 'parquet' or 'csv'")
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_portfolio(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists"
) -> None:
    if format == "parquet":
        df.write.mode(mode).parquet(path)
    elif format == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError("format must be 'parquet' or 'csv'")


def write_rate_tables(rates: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All rate tables as one Parquet table, a folder per predictor."""
    rates.repartition("variable").write.mode(mode).partitionBy("variable").parquet(path)


def read_rate_tables(
    spark: SparkSession, path: str, variables: Sequence[str] | None = None
) -> DataFrame:
    """The rate tables of all or some predictors; others are not opened."""
    # A predictor called 2024 must not come back as a number.
    schema = T.StructType(
        [f for f in spark.read.parquet(path).schema.fields if f.name != "variable"]
        + [T.StructField("variable", T.StringType())]
    )
    rates = spark.read.schema(schema).parquet(path)
    if variables is not None:
        rates = rates.where(F.col("variable").isin(list(variables)))
    return rates


def sample_rows(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows in the order of the hash of their key: the same rows every time.

    Each task keeps ``n`` rows and one task merges them, so this is for quick runs; use
    ``sample_share`` for large samples.
    """
    order = [F.md5(F.concat_ws("-", *[column(c).cast("string") for c in key]))]
    rest = [column(c) for c in df.columns if c not in key]
    return df.orderBy(*order, *[column(c) for c in key], *rest).limit(n)


def sample_share(df: DataFrame, share: float, key: Sequence[str]) -> DataFrame:
    """About a share of the keys, all rows of a key together; a filter without shuffle."""
    bound = int(share * (1 << 32))
    return df.where(hash32(*[column(c) for c in key], method="xxhash64") < F.lit(bound))


def append_rows(main: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both tables, matched by column name."""
    return main.unionByName(more)
