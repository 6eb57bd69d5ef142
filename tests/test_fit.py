import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import (
    Blueprint,
    PricingPipeline,
    RateModel,
    fit_glm,
    fit_lasso_glm,
    generate_all_ratetables,
    generate_blueprint,
    prepare_data,
    ratetable,
    validate_train_test_column,
)
from premia.operators import glm, kernels
from premia.operators.solver import kkt_gap, solve_quadratics
from premia.plans.compare import METHODS, compare_methods
from premia.streaming.scoring import read_stream, score_stream, write_scored

PREDICTORS = ["VehAge", "DrivAge", "Region"]
ROLES = {"weight_col": "Exposure", "divide_target_by_weight": True}


@pytest.fixture(scope="module")
def plan(policies):
    return generate_blueprint(policies.where("traintest = 1"), PREDICTORS)


@pytest.fixture(scope="module")
def pipeline(policies):
    return PricingPipeline.fit(
        policies, "ClaimNb", "Poisson", PREDICTORS, use_cv=False, base_rate=0.1, **ROLES
    )


def dense(plan, pdf, names):
    """The design matrix on the driver, for brute force."""
    cols = []
    for v in names:
        p = plan[v]
        if p.kind == "numeric":
            cols += [(pdf[v].to_numpy() < b).astype(float) for b in p.breaks]
        else:
            known = pdf[v].isin(p.levels)
            cols += [(pdf[v] == lv).to_numpy(float) for lv in p.levels] + [(~known).to_numpy(float)]
    return np.column_stack(cols)


FAMILIES = {
    "poisson": lambda d: (d.ClaimNb / d.Exposure, d.Exposure),
    "gamma": lambda d: (0.5 + d.DrivAge / 10 + d.ClaimNb, d.Exposure),
    "gaussian": lambda d: (d.DrivAge - 30.0 + 3 * d.ClaimNb, d.Exposure),
    "binomial": lambda d: (d.ClaimNb.clip(upper=2) / 2, d.Exposure),
}


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("l1_ratio, share", [(1.0, 0.05), (0.3, 0.01), (0.0, 1.0)])
def test_optimality_on_rows(spark, policies_pdf, plan, family, l1_ratio, share):
    pdf = policies_pdf.copy()
    pdf["y"], pdf["w"] = (np.asarray(v, float) for v in FAMILIES[family](pdf))
    df = spark.createDataFrame(pdf)
    alpha = 0.05 if l1_ratio == 0 else None
    if alpha is None:
        top = glm.alpha_max(df, "y", family, PREDICTORS, plan, weight_col="w", l1_ratio=l1_ratio)
        alpha = top.agg(F.max("alpha")).first()[0] * share
    model = fit_glm(df, "y", family, PREDICTORS, plan, weight_col="w", use_cv=False,
                    alpha=alpha, l1_ratio=l1_ratio)
    train = pdf[pdf.traintest == 1]
    x, y, w = dense(plan, train, PREDICTORS), train.y.to_numpy(), train.w.to_numpy()
    mu = kernels.mean_of(model.intercept + x @ model.coef, family)
    resid = kernels.residual(w, w * y, mu, family)
    mean = w @ x / w.sum()
    sd = np.sqrt(w @ (x - mean) ** 2 / w.sum())
    live = sd > 1e-9
    q = (resid @ x / w.sum())[live] / sd[live]
    gap = kkt_gap(q[None], (model.coef * sd)[live][None], np.array([alpha * l1_ratio]),
                  np.array([alpha * (1 - l1_ratio)]))
    assert gap[0] < 1e-7 * max(1.0, np.abs(q).max() * 100)
    assert abs(resid.sum() / w.sum()) < 1e-7 * max(1.0, np.abs(y).max())
    assert np.all(model.coef[~live] == 0)


def test_prediction_equals_dense_product(policies, policies_pdf, plan):
    model = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    want = np.exp(model.intercept + dense(plan, policies_pdf, PREDICTORS) @ model.coef)
    rows = model.predict(policies.withColumn("id", F.monotonically_increasing_id())).orderBy("id").collect()
    np.testing.assert_allclose([r["prediction"] for r in rows], want, rtol=1e-9)


def test_prepared_table_gives_the_same_model(policies, plan):
    direct = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    wide = prepare_data(PREDICTORS, ["ClaimNb", "traintest", "Exposure"], df=policies, formats=plan)
    prepared = fit_lasso_glm(wide, "ClaimNb", "traintest", "Poisson", "Exposure",
                             divide_target_by_weight=True, use_cv=False)
    a = [r[0] for r in direct.predict(policies).orderBy("DrivAge", "VehAge", "Exposure").select("prediction").collect()]
    ids = prepare_data(PREDICTORS, ["DrivAge", "VehAge", "Exposure"], df=policies, formats=plan)
    b = [r[0] for r in prepared.predict(ids).orderBy("DrivAge", "VehAge", "Exposure").select("prediction").collect()]
    np.testing.assert_allclose(a, b, rtol=1e-4)


def test_weights_and_division_only_on_request(policies):
    plan = Blueprint.from_lists({"Region": ["North", "South", "Urban"]})
    kw = {"use_cv": False, "alpha": 0.0, "drop_first": True}
    train = policies.where("traintest = 1 and Region = 'South'")
    n, claims, exposure, ratio, wy = train.agg(
        F.count("*"), F.sum("ClaimNb"), F.sum("Exposure"), F.sum(F.col("ClaimNb") / F.col("Exposure")),
        F.sum(F.col("ClaimNb") * F.col("Exposure")),
    ).first()

    def fitted(**options):
        model = fit_glm(policies, "ClaimNb", "Poisson", ["Region"], plan, **kw, **options)
        return model.predict(train).select("prediction").first()[0]

    assert fitted() == pytest.approx(claims / n)
    assert fitted(weight_col="Exposure") == pytest.approx(wy / exposure)
    assert fitted(**ROLES) == pytest.approx(claims / exposure)


def test_cross_validation_picks_the_best_and_refits(policies, plan):
    cv = {"n_alphas": 4, "l1_ratio": [0, 0.5, 1.0], "min_alpha_ratio": 1e-3, "cv": 3}
    model = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, cv_params=cv, **ROLES)
    assert len(model.grid) == 12
    best = min(model.grid, key=lambda g: g[2])
    assert (model.l1_ratio, model.alpha) == best[:2]
    again = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False,
                    alpha=model.alpha, l1_ratio=model.l1_ratio, **ROLES)
    np.testing.assert_allclose(model.coef, again.coef, atol=1e-6)
    assert np.isfinite(model.coef).all() and model.n_params == len(model.features)


def test_partitioning_and_chunks_do_not_change_the_fit(policies, plan, monkeypatch):
    cv = {"n_alphas": 3, "l1_ratio": [0.5, 1.0], "cv": 3}
    whole = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, cv_params=cv, **ROLES)
    monkeypatch.setattr(glm, "PASS_BUDGET", 6000)
    monkeypatch.setattr(glm, "FAN_IN", 2)
    from premia.operators import cells

    monkeypatch.setattr(cells, "MIN_CELLS_PER_TASK", 40)
    monkeypatch.setattr(cells, "MAX_CELLS_PER_TASK", 20)
    pieces = fit_glm(policies.repartition(7), "ClaimNb", "Poisson", PREDICTORS, plan, cv_params=cv, **ROLES)
    assert pieces.alpha == pytest.approx(whole.alpha) and pieces.l1_ratio == whole.l1_ratio
    np.testing.assert_allclose(pieces.coef, whole.coef, atol=1e-6)


def test_rows_that_do_not_compress_stay_rows(policies, plan, monkeypatch):
    from premia.operators import cells

    packed = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    monkeypatch.setattr(cells, "FEW_CELLS", 0)
    monkeypatch.setattr(cells, "WORTH_SHUFFLING", 0.0)
    loose = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    np.testing.assert_allclose(loose.coef, packed.coef, atol=1e-8)


def test_task_count():
    from premia.operators.cells import task_count

    assert task_count(100, 8) == 1
    assert task_count(20_000, 8) == 5
    assert task_count(10_000_000, 8) == 8
    assert task_count(100_000_000, 8) == 32


def test_null_values_in_the_fit_take_batch_means(spark, policies, plan):
    holes = policies.withColumn("VehAge", F.when(F.col("DrivAge") % 5 != 0, F.col("VehAge")))
    model = fit_glm(holes, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    mean = holes.agg(F.avg("VehAge")).first()[0]
    assert model.fill["VehAge"] == pytest.approx(mean)
    filled = policies.withColumn("VehAge", F.when(F.col("DrivAge") % 5 != 0, F.col("VehAge")).otherwise(F.lit(mean)))
    same = fit_glm(filled, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    np.testing.assert_allclose(model.coef, same.coef, atol=1e-9)


def test_solver_is_optimal_with_collinear_features():
    rng = np.random.default_rng(0)
    p, k = 12, 5
    a = rng.normal(size=(k, 30, p))
    a[:, :, 1] = a[:, :, 0]  # collinear
    h = np.einsum("kni,knj->kij", a, a) / 30
    c = np.einsum("kni,kn->ki", a, rng.normal(size=(k, 30))) / 30
    l1, l2 = np.full(k, 0.02), np.array([0.0, 0.0, 0.05, 0.5, 1.0])
    u = solve_quadratics(h, c, np.zeros((k, p)), l1, l2, np.full(k, 1e-10))
    q = c - np.einsum("kij,kj->ki", h, u)
    assert kkt_gap(q, u, l1, l2).max() < 1e-8


@pytest.mark.parametrize(
    "family, bad", [("Poisson", -1.0), ("Gamma", 0.0), ("Gaussian", math.inf), ("Binomial", 1.5), ("Poisson", None)]
)
def test_bad_targets_are_refused(spark, family, bad):
    rows = [(1.0, "a", 1, 1.0), (bad, "b", 0, 1.0)]
    df = spark.createDataFrame(rows, "y double, x string, traintest int, w double")
    with pytest.raises(ValueError, match="target must be"):
        fit_glm(df, "y", family, ["x"], {"x": ["a", "b"]}, use_cv=False)


def test_bad_weights_flags_families_and_columns(spark):
    df = spark.createDataFrame([(1.0, "a", 1, 0.0)], "y double, x string, traintest int, w double")
    plan = {"x": ["a"]}
    with pytest.raises(ValueError, match="Weights must be"):
        fit_glm(df, "y", "Gaussian", ["x"], plan, weight_col="w", use_cv=False)
    with pytest.raises(ValueError, match="Unknown model type"):
        fit_glm(df, "y", "Tweedie", ["x"], plan, use_cv=False)
    with pytest.raises(ValueError, match="no split column"):
        fit_glm(df, "y", "Gaussian", ["x"], plan, train_test_col="nope", use_cv=False)
    with pytest.raises(ValueError, match="no column"):
        fit_glm(df, "y", "Gaussian", ["z"], plan, use_cv=False)
    with pytest.raises(ValueError, match="empty"):
        fit_glm(df.limit(0), "y", "Gaussian", ["x"], plan, use_cv=False)


def test_flag_column(spark):
    def flags(*values):
        return spark.createDataFrame([(v,) for v in values], "f int")

    validate_train_test_column(flags(1, 0, None), "f")
    validate_train_test_column(flags(0, None), "f", require_training_rows=False)
    with pytest.raises(ValueError, match=r"also holds \[2, 3\]"):
        validate_train_test_column(flags(1, 3, 2), "f")
    with pytest.raises(ValueError, match="marks no row"):
        validate_train_test_column(flags(0, 0), "f")
    with pytest.raises(ValueError, match="no split column"):
        validate_train_test_column(flags(1), "g")


def test_pipeline_equals_its_steps(policies, plan, pipeline):
    model = fit_glm(policies, "ClaimNb", "Poisson", PREDICTORS, plan, use_cv=False, **ROLES)
    assert pipeline.blueprint.to_lists() == plan.to_lists()
    np.testing.assert_allclose(pipeline.model.coef, model.coef, atol=1e-8)
    rates = generate_all_ratetables(model, policies, PREDICTORS, plan)
    tariff = RateModel.from_rate_tables(rates, plan, 0.1)
    a = [r.relativity for r in pipeline.rate_model.variables["DrivAge"].rows]
    b = [r.relativity for r in tariff.variables["DrivAge"].rows]
    np.testing.assert_allclose(a, b, rtol=1e-6)


def test_pipeline_learns_from_training_rows_only(spark, policies):
    shifted = policies.withColumn(
        "DrivAge", F.when(F.col("traintest") == 0, F.col("DrivAge") + 1000).otherwise(F.col("DrivAge"))
    )
    got = PricingPipeline.fit(shifted, "ClaimNb", "Poisson", PREDICTORS, use_cv=False, **ROLES)
    assert max(got.blueprint["DrivAge"].breaks) < 100


def test_pipeline_accessors_and_store(spark, policies, pipeline, tmp_path):
    assert pipeline.base_rate == 0.1 and set(pipeline.relativities) == set(PREDICTORS)
    summary = pipeline.summary()
    assert summary["num_variables"] == 3 and summary["snapshots"] == 1
    assert pipeline.rate_model.metadata.exposure_col == "Exposure"
    path = str(tmp_path / "pipeline")
    pipeline.save(spark, path)
    loaded = PricingPipeline.load(spark, path)
    assert loaded.summary() == summary
    assert loaded.rate_model == pipeline.rate_model
    assert loaded.blueprint.to_lists() == pipeline.blueprint.to_lists()
    assert loaded.rates.count() == pipeline.rates.count()
    a = pipeline.predict(policies).agg(F.sum("prediction")).first()[0]
    assert loaded.predict(policies).agg(F.sum("prediction")).first()[0] == pytest.approx(a, rel=1e-12)


def test_custom_flag_name_and_empty_plan(spark, policies):
    df = policies.withColumnRenamed("traintest", "is_train").withColumn("nothing", F.lit(None).cast("double"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = PricingPipeline.fit(df, "ClaimNb", "Poisson", ["Region", "nothing"], train_test_col="is_train",
                                  use_cv=False, **ROLES)
    assert list(got.rate_model.variables) == ["Region"]
    assert got.rate_model.predict(df).count() == 500


def test_rate_table_median_and_prepare(policies, plan, pipeline):
    table = ratetable(pipeline.model, policies, "Region", ["North", "South", "Urban"]).collect()
    assert sorted(r["relativity"] for r in table)[1] == pytest.approx(1.0)
    assert [r["Region"] for r in table] == ["North", "South", "Urban"]
    bare = ratetable(pipeline.model, policies, "VehAge", [1, 5], include_raw=False)
    assert bare.columns == ["VehAge", "relativity"]
    wide = prepare_data(PREDICTORS, ["ClaimNb", "traintest", "Exposure"], df=policies, formats=plan)
    model = fit_lasso_glm(wide, "ClaimNb", "traintest", "Poisson", "Exposure",
                          divide_target_by_weight=True, use_cv=False)
    prepared = ratetable(
        model, policies, "Region", ["North", "South", "Urban"],
        prepare=lambda d: prepare_data(PREDICTORS, ["rate_level"], df=d, formats=plan),
    ).collect()
    for a, b in zip(table, prepared):
        assert a["relativity"] == pytest.approx(b["relativity"], rel=1e-3)


def test_compare_methods(policies):
    report = compare_methods(
        policies, "ClaimNb", "Poisson", ["VehAge", "Region"], weight_col="Exposure",
        cv_params={"n_alphas": 3, "l1_ratio": [1.0]}, gbt_iterations=2,
    ).collect()
    assert [r["Method"] for r in report] == list(METHODS)
    assert all(r["Deviance"] > 0 for r in report)
    with pytest.warns(UserWarning, match="failed"):
        failed = compare_methods(policies, "ClaimNb", "Gamma", ["VehAge"], methods=METHODS[:1]).first()
    assert failed["Deviance"] is None


def test_streams_are_scored_like_batches(spark, policies, pipeline, tmp_path):
    policies.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), policies.schema)
    scored = score_stream(score_stream(stream, pipeline.rate_model, "premium"), pipeline.model, "mean")
    write_scored(scored, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("premium"), F.sum("mean"), F.count("*")).first()
    batch = pipeline.model.predict(pipeline.rate_model.predict(policies, output_col="premium"), "mean")
    want = batch.agg(F.sum("premium"), F.sum("mean"), F.count("*")).first()
    assert tuple(got) == pytest.approx(tuple(want))
    with pytest.raises(ValueError, match="no batch mean"):
        pipeline.model.predict(stream.withColumn("VehAge", F.col("VehAge") + 0), fill="batch")


def test_folds_do_not_follow_the_outcome(spark):
    """One factor with claim rates of 5, 20 and 60 %: cross-validation keeps it."""
    rows = spark.range(6000).select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("level"),
        F.col("id"), F.lit(1).alias("traintest"),
    )
    rate = F.when(F.col("level") == "a", 5).when(F.col("level") == "b", 20).otherwise(60)
    data = rows.select("level", "traintest", (F.pmod(F.xxhash64("id"), F.lit(100)) < rate).cast("int").alias("claim"))
    cv = {"n_alphas": 4, "l1_ratio": [1.0], "min_alpha_ratio": 1e-3, "cv": 3}
    model = fit_glm(data, "claim", "Binomial", ["level"], {"level": ["a", "b", "c"]}, cv_params=cv)
    assert np.ptp(model.coef) > 1 and model.alpha == min(g[1] for g in model.grid)
