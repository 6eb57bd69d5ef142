"""The solver for many features against the dense one, and predictors with many levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import PricingPipeline, fit_glm, generate_blueprint
from premia.operators import blueprint as plans
from premia.operators.blueprint import Blueprint, VariablePlan
from premia.plans.portfolio import portfolio

TARGETS = {"poisson": "ClaimNb", "gamma": "severity", "gaussian": "margin", "binomial": "returned"}
PREDICTORS = ["discount", "p_size", "segment", "priority", "nation", "tax_null", "price"]


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    df = portfolio(spark, sf_dir).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def plan(data):
    # The price has no plan, so it enters as it is.
    return generate_blueprint(data.where("traintest = 1"), PREDICTORS[:-1])


def fit(data, plan, family, **options):
    params = {"cv_params": {"solver": options.pop("solver"), **options.pop("cv_params", {})}}
    return fit_glm(
        data, TARGETS[family], family, PREDICTORS, plan, weight_col="Exposure",
        divide_target_by_weight=family == "poisson", fold_key=["l_orderkey", "l_linenumber"], **params, **options,
    )


@pytest.mark.parametrize("family", list(TARGETS))
@pytest.mark.parametrize("l1_ratio", [1.0, 0.3])
def test_same_as_dense(data, plan, family, l1_ratio):
    scale = {"poisson": 1e-3, "gamma": 1e-3, "gaussian": 1.0, "binomial": 1e-3}[family]
    a, b = (fit(data, plan, family, use_cv=False, alpha=scale, l1_ratio=l1_ratio, solver=s) for s in ("dense", "active"))
    assert a.gap < 1e-8 and b.gap < 1e-8
    assert [f.name for f in a.features] == [f.name for f in b.features]
    assert a.train_deviance == pytest.approx(b.train_deviance, rel=1e-9)
    eta = [np.concatenate([*m.contributions.values(), list(m.raw_slopes.values())]) for m in (a, b)]
    assert np.abs(eta[0] - eta[1]).max() < 1e-4 * max(1.0, np.abs(eta[0]).max())


@pytest.mark.parametrize("l1_ratio", [0.0, 0.7])
def test_scores_alone_reach_the_same(data, plan, l1_ratio, monkeypatch):
    """A set of active features above the limit is solved without any matrix."""
    from premia.operators import wide

    monkeypatch.setattr(wide, "ACTIVE_LIMIT", 3)
    a, b = (fit(data, plan, "poisson", use_cv=False, alpha=0.05, l1_ratio=l1_ratio, solver=s) for s in ("dense", "active"))
    assert b.gap <= 1e-6
    assert a.train_deviance == pytest.approx(b.train_deviance, rel=1e-6)


def test_grid_agrees(data, plan):
    params = {"n_alphas": 6, "l1_ratio": [0.0, 1.0], "min_alpha_ratio": 1e-2, "cv": 3}
    a, b = (fit(data, plan, "poisson", solver=s, cv_params=params) for s in ("dense", "active"))
    assert (a.alpha, a.l1_ratio) == pytest.approx((b.alpha, b.l1_ratio))
    for x, y in zip(a.grid, b.grid):
        assert x[:3] == pytest.approx(y[:3], rel=1e-5)
        assert y[3]
    assert len(b.fold_grid) == 3 * len(b.grid)
    assert {r[2] for r in b.fold_grid} == {0, 1, 2}


def test_more_levels_than_a_list_holds(spark, data, monkeypatch):
    """Threshold 0 keeps every level; with few listed levels the same plan is a table."""
    keyed = data.withColumn("part", F.when(F.col("l_orderkey") % 17 != 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))
    names = ["part", "discount"]
    results = []
    for listed in (100_000, 50):
        monkeypatch.setattr(plans, "LISTED_LEVELS", listed)
        plan = generate_blueprint(keyed.where("traintest = 1"), names, threshold=0.0)
        assert (plan["part"].table is not None) == (listed == 50)
        model = fit_glm(
            keyed, "ClaimNb", "Poisson", names, plan, weight_col="Exposure", divide_target_by_weight=True, use_cv=False, alpha=2e-3,
            cv_params={"solver": "active"},
        )
        scored = model.predict(keyed).select("l_orderkey", "l_linenumber", F.round("prediction", 8).alias("p"))
        effects = {r["feature"]: r["coef"] for r in model.coefficients(spark).collect()}
        results.append((sorted(map(tuple, scored.collect())), effects))
    (a, x), (b, y) = results
    assert set(x) == set(y)
    assert max(abs(x[f] - y[f]) for f in x) < 1e-6
    assert np.abs(np.array(a) - np.array(b)).max() < 1e-6


def test_pipeline_with_many_levels(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "LISTED_LEVELS", 60)
    keyed = data.withColumn("part", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    pipeline = PricingPipeline.fit(
        keyed, "ClaimNb", "Poisson", ["part", "p_size"], weight_col="Exposure", divide_target_by_weight=True, use_cv=False,
        threshold=0.0, base_rate=0.1, cv_params={"fit_intercept": True},
    )
    assert pipeline.blueprint["part"].table is not None
    tariff = pipeline.rate_model.predict(keyed, exposure_col=None).select("prediction").agg(F.sum("prediction")).first()[0]
    pipeline.save(spark, str(tmp_path / "p"))
    again = PricingPipeline.load(spark, str(tmp_path / "p"))
    assert again.rate_model.predict(keyed, exposure_col=None).agg(F.sum("prediction")).first()[0] == pytest.approx(tariff)
    a, b = (sorted(map(tuple, p.predict(keyed).select("l_orderkey", "l_linenumber", "prediction").collect())) for p in (pipeline, again))
    assert a == b


def test_one_predictor_above_ten_thousand_levels(spark):
    """Each level has its own rate; an unpenalised fit finds the level's mean."""
    n = 12_000
    rows = spark.range(n * 3).select(
        F.concat(F.lit("k"), (F.col("id") % n).cast("string")).alias("k"), (1 + (F.col("id") % n) % 5).cast("double").alias("y"), F.lit(1).alias("traintest")
    )
    model = fit_glm(rows, "y", "Gaussian", ["k"], Blueprint({}), use_cv=False, alpha=1e-4, l1_ratio=0.0)
    assert model.blueprint["k"].table.size == n and model.n_params == n + 1
    off = model.predict(rows).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off < 0.01


def test_empty_design(data):
    model = fit_glm(
        data, "ClaimNb", "Poisson", ["segment"], Blueprint({"segment": VariablePlan("categorical", levels=("nowhere",))}), weight_col="Exposure",
        divide_target_by_weight=True, use_cv=False, cv_params={"solver": "active"},
    )
    assert not np.any(model.coef)
