import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import Blueprint, generate_blueprint, lump_rare_levels
from premia.operators.quantiles import linear_quantiles, nearest_quantiles, order_statistics

PROBS = [0.05 + i * 0.05 for i in range(20)]


def brute(values, probs):
    x = np.sort(np.asarray([v for v in values if v is not None and not math.isnan(v)], float))
    return [x[min(max(math.floor(q * (len(x) - 1) + 0.5), 0), len(x) - 1)] for q in probs]


def test_kinds(policies):
    plan = generate_blueprint(policies)
    assert plan["VehAge"].kind == "numeric"
    assert list(plan["VehAge"].breaks) == sorted(set(plan["VehAge"].breaks))
    assert plan["Region"].levels == ("North", "South", "Urban")


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None)] * 5, "num double, cat string")
    assert generate_blueprint(df).to_lists() == {"num": [], "cat": []}


def test_mostly_null_columns(spark):
    rows = [(1.0, "A"), (None, None), (3.0, "C"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "num double, cat string")
    assert generate_blueprint(df).to_lists() == {"num": [1.0, 3.0], "cat": ["A", "C"]}


def test_genuine_other_level_is_dropped_and_rare_levels_lumped(spark):
    rows = [("A",)] * 600 + [("Other",)] * 399 + [("rare",)]
    df = spark.createDataFrame(rows, "cat string")
    assert generate_blueprint(df).to_lists() == {"cat": ["A"]}


def test_share_is_of_non_null_rows(spark):
    rows = [("A",)] * 9 + [("B",)] * 1 + [(None,)] * 90
    df = spark.createDataFrame(rows, "cat string")
    assert generate_blueprint(df, threshold=0.1).to_lists() == {"cat": ["A", "B"]}


def test_small_integers_booleans_and_dates_are_categories(spark):
    df = spark.createDataFrame([(1, True), (0, False)], "a int, b boolean").select(
        F.col("a").cast("tinyint").alias("flag"), "b"
    )
    assert generate_blueprint(df).to_lists() == {"flag": ["0", "1"], "b": ["false", "true"]}


def test_unsupported_column_does_not_stop_the_others(spark):
    df = spark.createDataFrame([([1], 2.0)], "arr array<int>, x double")
    with pytest.warns(UserWarning):
        plan = generate_blueprint(df)
    assert plan["arr"].kind == "error" and plan["x"].breaks == (2.0,)


def test_blueprint_round_trips_through_a_table(spark, policies):
    plan = generate_blueprint(policies)
    again = Blueprint.from_dataframe(plan.to_dataframe(spark), list(plan))
    assert again.to_lists() == plan.to_lists()


@pytest.mark.parametrize("limit", [1_000_000, 500, 7])
def test_order_statistics_equal_brute_force(spark, limit):
    rng = np.random.default_rng(1)
    n = 4000
    heavy = np.exp(rng.normal(0, 8, n))
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1, n).round(2))
    ints = rng.integers(-5, 5, n).astype(float)
    holes = np.where(rng.random(n) < 0.5, np.nan, rng.random(n))
    rows = [
        (float(a), float(b), float(c), None if i % 3 == 0 else float(d))
        for i, (a, b, c, d) in enumerate(zip(heavy, hot, ints, holes))
    ]
    df = spark.createDataFrame(rows, "heavy double, hot double, ints double, holes double")
    names = df.columns
    found = nearest_quantiles(df.repartition(5), names, PROBS, rank_limit=limit)
    for i, c in enumerate(names):
        assert found[c] == brute([r[i] for r in rows], PROBS), c


def test_linear_quantiles_equal_numpy(spark):
    x = np.random.default_rng(3).normal(size=1001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.1, 0.25, 0.5, 0.9]
    found = linear_quantiles(df, ["x"], probs, rank_limit=50)["x"]
    np.testing.assert_allclose(found, np.quantile(x, probs), rtol=1e-12)


def test_infinite_values_are_ordered(spark):
    rows = [(float("-inf"),), (1.0,), (2.0,), (float("inf"),)] * 5
    df = spark.createDataFrame(rows, "x double")
    _, got = order_statistics(df, ["x"], lambda _c, n: [0, 5, 10, n - 1], rank_limit=2)
    assert got["x"] == {0: -math.inf, 5: 1.0, 10: 2.0, 19: math.inf}


def test_lump_rare_levels(spark):
    rows = [("A",)] * 50 + [("B",)] * 45 + [("C",)] * 4 + [(None,)]
    df = spark.createDataFrame(rows, "x string")
    got = {r["x"]: r["count"] for r in lump_rare_levels(df, "x", threshold=0.05).groupBy("x").count().collect()}
    assert got == {"A": 50, "B": 45, "Other": 4, None: 1}
    # The join form gives the same.
    joined = lump_rare_levels(df, "x", threshold=0.0005, total_count=90_000)
    got = {r["x"]: r["count"] for r in joined.groupBy("x").count().collect()}
    assert got == {"A": 50, "B": 45, "Other": 4, None: 1}


def test_threshold_zero_changes_nothing(spark):
    df = spark.createDataFrame([("A",), ("B",)], "x string")
    assert lump_rare_levels(df, "x", threshold=0.0).where("x = 'Other'").count() == 0
