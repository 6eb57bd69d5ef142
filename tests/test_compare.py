"""Trees and GLM on rows summed by their features against the same on plain rows."""

import pytest

from premia.operators.blueprint import Blueprint, level_counts, level_plans
from premia.plans import compare


@pytest.fixture
def some(policies):
    # Repeats, so that few combinations of features hold many rows.
    return policies.select("VehAge", "Region", "ClaimNb", "Exposure", "traintest")


def test_training_rows_are_summed(some):
    train = some.where("traintest = 1")
    plans = Blueprint(level_plans(level_counts(train, ["Region"]), ["Region"]))
    made = compare._vectors(train, ["VehAge"], plans, "ClaimNb", "Exposure", summed=True)
    n = train.select("VehAge", "Region").distinct().count()
    assert made.count() <= n < train.count()
    sums = made.selectExpr("sum(weight)", "sum(weight * label)").first()
    want = train.selectExpr("sum(Exposure)", "sum(Exposure * ClaimNb)").first()
    assert sums[0] == pytest.approx(want[0]) and sums[1] == pytest.approx(want[1])


def test_same_report_on_plain_rows(some, monkeypatch):
    def report():
        rows = compare.compare_methods(
            some, "ClaimNb", "Poisson", ["VehAge", "Region"], weight_col="Exposure", methods=compare.METHODS[2:], gbt_iterations=3
        ).collect()
        return [(r["Method"], r["Deviance"], r["RMSE"], r["MAE"], r["NParams"]) for r in rows]

    summed = report()
    monkeypatch.setattr(compare, "compresses", lambda *_: False)
    plain = report()
    assert [r[0] for r in summed] == list(compare.METHODS[2:])
    for a, b in zip(summed, plain):
        assert a[1:] == pytest.approx(b[1:], abs=2e-4)


def test_null_label_stays_null(spark):
    rows = spark.createDataFrame([(None, 1.0, 2.0)] + [(1.0, 2.0, 2.0)] * 9, "label double, weight double, n0 double")
    got = sorted(compare._summed(rows).collect(), key=str)
    assert [(r["label"], r["weight"]) for r in got] == [(1.0, 18.0), (None, None)]
