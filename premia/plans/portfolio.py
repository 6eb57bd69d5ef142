"""The portfolio view: order lines joined to their risk attributes, one row per exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.split import hash32, train_flag

# Planted factors the fits must find again.
SEGMENT_FACTORS = {"BUILDING": 1.5, "MACHINERY": 0.7}
BASE_FREQUENCY = 0.04
NULL_EVERY = 17


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to order, customer, nation and part, with roles and targets.

    Joins carry no hints: Spark broadcasts a side by its measured size and splits
    skewed partitions of the others.  Orders meet their customers before the lines, of
    which there are several to an order, so lines are shuffled for two keys and not three.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer")
    nations = read_table(spark, sf_dir, "nation")
    parts = read_table(spark, sf_dir, "part")
    holders = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(holders, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        placed, F.col("l_orderkey") == F.col("o_orderkey")
    )
    factor = F.lit(1.0)
    for segment, value in SEGMENT_FACTORS.items():
        factor = F.when(F.col("c_mktsegment") == segment, value).otherwise(factor)
    exposure = F.col("l_quantity") / 50
    slope = 1 + F.lit(0.01) * F.col("p_size")
    h = hash32(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")) % 10000
    gap = F.col("l_orderkey") % NULL_EVERY == 0
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        "p_size",
        F.col("l_extendedprice").alias("price"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("n_name").alias("nation"),
        F.col("p_brand").alias("brand"),
        F.concat("p_brand", "p_type").alias("brand_type"),
        exposure.alias("Exposure"),
        train_flag(F.col("l_orderkey")).alias("traintest"),
        (h < 10000 * BASE_FREQUENCY * slope * factor * exposure).cast("int").alias("ClaimNb"),
        (F.col("l_extendedprice") / 10 * slope * factor).alias("severity"),
        (F.col("c_acctbal") + 20 * F.col("p_size")).alias("margin"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        F.when(~gap, F.col("l_tax")).alias("tax_null"),
        F.when(~gap, F.col("c_mktsegment")).alias("segment_null"),
    )
