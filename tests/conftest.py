from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policies_pdf() -> pd.DataFrame:
    """Order lines of the given tables as policies; claims follow size, customer segment and exposure."""
    lines, orders, customers, parts = (
        pd.read_parquet(f"{SF_DIR}/{t}.parquet") for t in ("lineitem", "orders", "customer", "part")
    )
    rows = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(customers, left_on="o_custkey", right_on="c_custkey")
    rows = rows.merge(parts, left_on="l_partkey", right_on="p_partkey").sort_values(["l_orderkey", "l_linenumber", "l_partkey"]).head(500)
    places = {"AUTOMOBILE": "North", "BUILDING": "South", "FURNITURE": "North", "HOUSEHOLD": "Urban", "MACHINERY": "Urban"}
    region = rows["c_mktsegment"].map(places)
    exposure = (rows["l_quantity"].astype(float) + 5) / 60
    rate = (0.08 + 0.004 * rows["p_size"]) * region.map({"North": 1.0, "South": 1.4, "Urban": 2.2})
    # An even spread instead of a draw: the same claims on every run.
    spread = (rows["l_orderkey"] * 31 + rows["l_linenumber"] * 7 + rows["l_partkey"]) % 97 / 97
    table = pd.DataFrame(
        {
            "VehAge": (rows["p_size"] % 13).astype("int64"),
            "DrivAge": (20 + rows["l_suppkey"] % 45).astype("int64"),
            "Region": region,
            "Exposure": exposure,
            "ClaimNb": np.floor(exposure * rate * 3 + spread).astype("int64"),
            "traintest": (rows["l_orderkey"] % 4 != 1).astype("int32"),
        }
    )
    return table.reset_index(drop=True)


@pytest.fixture(scope="session")
def policies(spark, policies_pdf):
    df = spark.createDataFrame(policies_pdf).persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR
