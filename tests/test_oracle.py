"""Registered queries against the same rows computed by DuckDB.

Runs all queries but the slower fits; ``ORACLE=all`` runs those as well.
"""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registered

SLOW = ("m1_", "m2_", "m3_", "m7_", "m8_", "m9_", "m10_", "s6_", "p16_")
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()
NAMES = [n for n in QUERIES if os.environ.get("ORACLE") == "all" or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, rows) == sorted_rows(names, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() == 15
