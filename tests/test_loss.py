import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import evaluate
from premia.functions.loss import FAMILIES, deviance, family_name, mae, rmse

Y = {"poisson": [0.0, 1.0, 3.0], "gamma": [0.5, 1.0, 2.0], "gaussian": [-1.0, 0.0, 2.0],
     "binomial": [0.0, 1.0, 0.25]}


def value(spark, expr, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    return df.agg(expr(F.col("y"), F.col("p"))).first()[0]


@pytest.mark.parametrize("family", ["poisson", "gamma", "gaussian"])
def test_perfect_fit_has_no_deviance(spark, family):
    y = [v for v in Y[family] if family != "poisson" or v > 0]
    assert value(spark, lambda a, b: deviance(a, b, family), y, y) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("family", FAMILIES)
def test_deviance_against_numpy(spark, family):
    y = np.array(Y[family])
    p = np.array([0.2, 0.7, 0.4])
    with np.errstate(divide="ignore", invalid="ignore"):
        want = {
            "poisson": lambda: 2 * np.mean(np.where(y == 0, p, y * np.log(y / p) - (y - p))),
            "gamma": lambda: 2 * np.mean((y - p) / p - np.log(y / p)),
            "gaussian": lambda: np.mean((y - p) ** 2),
            "binomial": lambda: -2 * np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)),
        }[family]()
    got = value(spark, lambda a, b: deviance(a, b, family), y.tolist(), p.tolist())
    assert got == pytest.approx(want)


def test_extreme_predictions_are_clipped(spark):
    assert np.isfinite(value(spark, lambda a, b: deviance(a, b, "binomial"), [1.0, 0.0], [0.0, 1.0]))
    assert np.isfinite(value(spark, lambda a, b: deviance(a, b, "poisson"), [1.0], [0.0]))


def test_errors(spark):
    assert value(spark, rmse, [0.0, 0.0], [3.0, 4.0]) == pytest.approx(np.sqrt(12.5))
    assert value(spark, mae, [0.0, 0.0], [3.0, -4.0]) == pytest.approx(3.5)
    df = spark.createDataFrame([(1.0, 1.0)], "y double, p double")
    assert evaluate(df, "y", "p", "Gaussian").first().asDict() == {"deviance": 0.0, "rmse": 0.0, "mae": 0.0}
    with pytest.raises(ValueError):
        family_name("tweedie")
