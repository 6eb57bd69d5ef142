"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.plans.portfolio import portfolio
from premia.session import ScratchTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows from the raw tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def pf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio(spark, sf_dir)


def pf_once(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Columns of the portfolio for a query that reads them several times: its joins run once."""
    return ScratchTable(pf(spark, sf_dir).select(*columns), "portfolio").df


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def rs(x: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


# The portfolio view in SQL, as common table expressions ``base`` and ``pf``.
PF = """
base AS (
  SELECT l.*, o_orderpriority, o_orderstatus, c_mktsegment, c_acctbal, n_name,
         p_size, p_brand, p_type,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5::DOUBLE
              WHEN c_mktsegment = 'MACHINERY' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS seg,
         1 + 0.01::DOUBLE * p_size AS slope,
         ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey)), 1, 8))::BIGINT
           % 10000 AS h
  FROM lineitem l
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
),
pf AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         l_discount AS discount, l_tax AS tax, p_size, l_extendedprice AS price,
         c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status,
         n_name AS nation, p_brand AS brand, p_brand || p_type AS brand_type,
         l_quantity / 50 AS Exposure,
         CASE WHEN ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 70
              THEN 1 ELSE 0 END AS traintest,
         CASE WHEN h < 400.0::DOUBLE * slope * seg * (l_quantity / 50) THEN 1 ELSE 0 END AS ClaimNb,
         l_extendedprice / 10 * slope * seg AS severity,
         c_acctbal + 20 * p_size AS margin,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
         CASE WHEN l_orderkey % 17 <> 0 THEN l_tax END AS tax_null,
         CASE WHEN l_orderkey % 17 <> 0 THEN c_mktsegment END AS segment_null
  FROM base
)
"""


def with_pf(sql: str) -> str:
    """A SELECT over ``pf``; further expressions may follow ``pf`` with a comma."""
    sql = sql.strip()
    return f"WITH {PF}{', ' + sql[1:] if sql.startswith(',') else sql}"
