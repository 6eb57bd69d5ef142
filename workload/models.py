"""Fits, predictions and the pipeline."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from premia.functions.names import column
from premia.operators.blueprint import Blueprint, VariablePlan, generate_blueprint
from premia.operators.glm import alpha_max, fit_glm, fit_lasso_glm, predict_with_model
from premia.operators.prepare import prepare_data, with_bins
from premia.plans.compare import METHODS, compare_methods
from premia.plans.pipeline import PricingPipeline
from premia.session import scratch_path
from workload.binning import KEYS, KEYS_SQL, quantile_sql
from workload.registry import pf, pf_once, query, r, rs, with_pf
from workload.tariffs import EFFECTS, effects_model, eta_sql

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_PLAN = Blueprint({"segment": VariablePlan("categorical", levels=SEGMENTS)})

# Target, weight, and whether the target is divided by it.
ROLES = {
    "poisson": ("ClaimNb", "Exposure", True),
    "gamma": ("severity", "Exposure", False),
    "gaussian": ("margin", None, False),
    "binomial": ("ClaimNb", "Exposure", False),
}


def roles(family):
    target, weight, divide = ROLES[family]
    return {"weight_col": weight, "divide_target_by_weight": divide}


def fit_rows(spark, sf, family, predictors, *more):
    """What a fit reads of the portfolio, written once."""
    target, weight, _ = ROLES[family]
    needed = [*predictors, target, *([weight] if weight else []), "traintest", *more]
    return pf_once(spark, sf, *dict.fromkeys(needed))


def sums_sql(family) -> tuple[str, str]:
    """Sum of w*y and of w over rows of ``pf``."""
    target, weight, divide = ROLES[family]
    w = weight or "1"
    y = f"({target} / {w})" if divide else target
    return f"sum({w} * {y})", f"sum({w})"


def _saturated(family):
    wy, w = sums_sql(family)
    digits = 2 if family in ("gamma", "gaussian") else 6

    @query(
        f"m1_saturated_{family}",
        with_pf(
            f"SELECT segment, {rs(f'{wy} / {w}', digits)} AS fitted FROM pf WHERE traintest = 1 GROUP BY 1"
        ),
    )
    def run(spark, sf):
        data = fit_rows(spark, sf, family, ["segment"])
        model = fit_glm(
            data, ROLES[family][0], family, ["segment"], SEGMENT_PLAN, use_cv=False, alpha=0.0,
            drop_first=True, **roles(family),
        )
        train = data.where("traintest = 1")
        fitted = model.predict(train, "fitted").groupBy("segment").agg(F.avg("fitted").alias("fitted"))
        return fitted.select("segment", r("fitted", digits).alias("fitted"))

    return run


def _null_model(family):
    wy, w = sums_sql(family)
    digits = 2 if family in ("gamma", "gaussian") else 6

    @query(
        f"m2_all_shrunk_{family}",
        with_pf(
            f"SELECT 0::BIGINT AS n_nonzero, {rs(f'{wy} / {w}', digits)} AS fitted FROM pf WHERE traintest = 1"
        ),
    )
    def run(spark, sf):
        data = fit_rows(spark, sf, family, ["segment", "discount", "p_size"])
        plan = generate_blueprint(data.where("traintest = 1"), ["segment", "discount", "p_size"])
        names = list(plan)
        top = alpha_max(data, ROLES[family][0], family, names, plan, **roles(family))
        alpha = top.agg(F.max("alpha")).first()[0]
        model = fit_glm(
            data, ROLES[family][0], family, names, plan, use_cv=False, alpha=alpha * 1.0001,
            **roles(family),
        )
        n = int((model.coef != 0).sum())
        scored = model.predict(data.where("traintest = 1"), "fitted")
        return scored.agg(r(F.avg("fitted"), digits).alias("fitted")).select(
            F.lit(n).cast("bigint").alias("n_nonzero"), "fitted"
        )

    return run


def _balance(family):
    """With a free intercept a fit balances, whatever the penalty."""
    wy, w = sums_sql(family)
    # The gamma fit balances the ratio of actual to fitted, the others the totals.
    total = w if family == "gamma" else wy
    digits = 0 if family == "gaussian" else 3

    @query(
        f"m2_balance_{family}",
        with_pf(f"SELECT {rs(total, digits)} AS balance FROM pf WHERE traintest = 1"),
    )
    def run(spark, sf):
        data = fit_rows(spark, sf, family, ["segment", "discount", "p_size", "brand"])
        target, weight, divide = ROLES[family]
        train = data.where("traintest = 1")
        plan = generate_blueprint(train, ["segment", "discount", "p_size", "brand"])
        model = fit_glm(
            data, target, family, list(plan), plan, use_cv=False, alpha=None, **roles(family)
        )
        wcol = column(weight) if weight else F.lit(1.0)
        y = F.col(target) / wcol if divide else F.col(target)
        value = wcol * y / F.col("fitted") if family == "gamma" else wcol * F.col("fitted")
        return model.predict(train, "fitted").agg(r(F.sum(value), digits).alias("balance"))

    return run


for _family in ROLES:
    _saturated(_family)
    _null_model(_family)
    _balance(_family)

_L1, _ALPHA = 0.5, 40.0


@query(
    "m1_soft_threshold_gaussian",
    with_pf(
        f""", t AS (SELECT segment, sum(Exposure * margin) AS wy, sum(Exposure) AS w FROM pf
             WHERE traintest = 1 GROUP BY 1), a AS (SELECT sum(w) AS total FROM t)
        SELECT segment, {rs(f'''sign(wy / total) * greatest(abs(wy / total) - {_ALPHA} * {_L1}, 0)
          / (w / total + {_ALPHA} * (1 - {_L1}))''', 4)} AS coef FROM t, a"""
    ),
)
def m1_soft(spark, sf):
    model = fit_glm(
        fit_rows(spark, sf, "gaussian", ["segment"], "Exposure"), "margin", "gaussian", ["segment"], SEGMENT_PLAN, weight_col="Exposure",
        use_cv=False, alpha=_ALPHA, l1_ratio=_L1,
        cv_params={"fit_intercept": False, "scale_predictors": False},
    )
    rows = model.coefficients(spark).where(F.col("variable") == "segment")
    level = F.regexp_extract("feature", r"\[(.*)\]", 1)
    return rows.select(level.alias("segment"), r("coef", 4).alias("coef")).where(
        F.col("segment") != "Other"
    )


KKT_VARIABLES = ["discount", "p_size"]


def kkt_violations(spark, sf, family, l1_ratio, alpha_share):
    """Optimality of a fit, checked on raw rows and wide indicator columns."""
    data = fit_rows(spark, sf, family, KKT_VARIABLES)
    target, weight, divide = ROLES[family]
    train = data.where("traintest = 1")
    plan = generate_blueprint(train, KKT_VARIABLES)
    top = alpha_max(data, target, family, KKT_VARIABLES, plan, **roles(family))
    alpha = top.agg(F.max("alpha")).first()[0] * alpha_share
    model = fit_glm(
        data, target, family, KKT_VARIABLES, plan, use_cv=False, alpha=alpha, l1_ratio=l1_ratio,
        **roles(family),
    )
    coefs = {f.name: float(b) for f, b in zip(model.features, model.coef)}
    variable = {f.name: f.variable for f in model.features}
    w = column(weight) if weight else F.lit(1.0)
    y = F.col(target) / w if divide else F.col(target)
    slope = 1 / F.col("fitted") if family == "gamma" else F.lit(1.0)
    scored = model.predict(train, "fitted").withColumns(
        {"w": w, "resid": w * (y - F.col("fitted")) * slope}
    )
    wide = prepare_data(KKT_VARIABLES, ["w", "resid"], df=scored, formats=plan)
    names = list(coefs)
    sums = []
    for i, f in enumerate(names):
        x = column(f)
        sums += [F.sum(F.col("resid") * x).alias(f"g{i}"), F.sum(F.col("w") * x).alias(f"m{i}")]
    row = wide.agg(F.sum("w").alias("w"), *sums).first()
    found: dict[str, list[int]] = {v: [0, 0] for v in KKT_VARIABLES}
    tol = 1e-6 * alpha / alpha_share
    for i, f in enumerate(names):
        found[variable[f]][0] += 1
        m = row[f"m{i}"] / row["w"]
        sd = math.sqrt(max(m * (1 - m), 0.0))
        if sd < 1e-9:
            continue
        b = coefs[f] * sd
        inner = row[f"g{i}"] / row["w"] / sd - alpha * (1 - l1_ratio) * b
        limit = alpha * l1_ratio
        gap = abs(inner) - limit if b == 0 else abs(inner - math.copysign(limit, b))
        found[variable[f]][1] += gap > tol
    return spark.createDataFrame(
        [(v, n, bad) for v, (n, bad) in found.items()],
        "variable string, n_features bigint, n_violations bigint",
    )


KKT_SQL = with_pf(
    f""", {quantile_sql(KKT_VARIABLES)}
    SELECT variable, count(*)::BIGINT AS n_features, 0::BIGINT AS n_violations FROM brk GROUP BY 1"""
)


def _kkt(family, l1_ratio, share):
    @query(f"m1_optimality_{family}", KKT_SQL)
    def run(spark, sf):
        return kkt_violations(spark, sf, family, l1_ratio, share)

    return run


for _family, _rho, _share in (
    ("poisson", 1.0, 0.05), ("gamma", 0.5, 0.01), ("gaussian", 0.7, 0.02), ("binomial", 1.0, 0.02),
):
    _kkt(_family, _rho, _share)

CV = {"n_alphas": 6, "min_alpha_ratio": 1e-3, "l1_ratio": [0.5, 1.0]}


@query(
    "m3_cross_validation",
    """SELECT 12::BIGINT AS n_penalties, 2::BIGINT AS n_ratios, true AS best_is_least,
    true AS beats_null_model, (SELECT count(DISTINCT c_mktsegment) FROM customer)::BIGINT AS n_levels""",
)
def m3(spark, sf):
    return _cross_validated(spark, sf, CV)


@query(
    "m3_default_grid",
    """SELECT 300::BIGINT AS n_penalties, 3::BIGINT AS n_ratios, true AS best_is_least,
    true AS beats_null_model, (SELECT count(DISTINCT c_mktsegment) FROM customer)::BIGINT AS n_levels""",
)
def m3_default(spark, sf):
    return _cross_validated(spark, sf, {})


def _cross_validated(spark, sf, cv_params):
    data = fit_rows(spark, sf, "gamma", ["segment", "discount"])
    plan = generate_blueprint(data.where("traintest = 1"), ["segment", "discount"])
    model = fit_glm(data, "severity", "gamma", list(plan), plan, cv_params=cv_params)
    grid = model.grid_table(spark)
    best = (F.col("l1_ratio") == model.l1_ratio) & (F.col("alpha") == model.alpha)
    n = len(plan["segment"].levels)
    return grid.agg(
        F.count(F.lit(1)).alias("n_penalties"),
        F.countDistinct("l1_ratio").alias("n_ratios"),
        (F.min("held_out_deviance") == F.min(F.when(best, F.col("held_out_deviance")))).alias(
            "best_is_least"
        ),
        (
            F.min("held_out_deviance")
            < F.max_by("held_out_deviance", F.col("alpha"))
        ).alias("beats_null_model"),
        F.lit(n).cast("bigint").alias("n_levels"),
    )


@query("m3_grid")
def m3_grid(spark, sf):
    data = fit_rows(spark, sf, "poisson", ["segment", "discount"])
    plan = generate_blueprint(data.where("traintest = 1"), ["segment", "discount"])
    model = fit_glm(
        data, "ClaimNb", "poisson", list(plan), plan, weight_col="Exposure",
        divide_target_by_weight=True,
    )
    return model.grid_table(spark)


_FEATURES = [("discount", b) for b in (0.02, 0.05)] + [("p_size", b) for b in (10.0, 30.0)]


def _alpha_sql():
    parts = [
        f"SELECT '{v}' AS variable, '{v}{b}' AS feature, CASE WHEN {v} < {b}::DOUBLE THEN 1 ELSE 0 END AS x, "
        "Exposure AS w, ClaimNb / Exposure AS y FROM pf WHERE traintest = 1"
        for v, b in _FEATURES
    ]
    parts += [
        f"SELECT 'segment', 'segment_lumped[{lv}]', CASE WHEN segment = '{lv}' THEN 1 ELSE 0 END, "
        "Exposure, ClaimNb / Exposure FROM pf WHERE traintest = 1"
        for lv in SEGMENTS
    ]
    return with_pf(
        f""", f AS ({' UNION ALL '.join(parts)}),
        a AS (SELECT sum(Exposure * (ClaimNb / Exposure)) / sum(Exposure) AS mu FROM pf WHERE traintest = 1),
        g AS (SELECT variable, feature, sum(w * x * (y - mu)) / sum(w) AS s, sum(w * x) / sum(w) AS m
              FROM f, a GROUP BY 1, 2)
        SELECT variable, feature, {rs('s / sqrt(m - m * m)')} AS gradient,
        {rs('abs(s) / sqrt(m - m * m) / 0.5')} AS alpha FROM g"""
    )


@query("m4_alpha_max", _alpha_sql())
def m4(spark, sf):
    plan = Blueprint.from_lists(
        {"discount": [0.02, 0.05], "p_size": [10, 30], "segment": list(SEGMENTS)}
    )
    found = alpha_max(
        fit_rows(spark, sf, "poisson", list(plan)), "ClaimNb", "poisson", list(plan), plan, weight_col="Exposure",
        divide_target_by_weight=True, l1_ratio=0.5,
    )
    return found.where(~F.col("feature").endswith("[Other]")).withColumns(
        {"gradient": r("gradient"), "alpha": r("alpha")}
    )


@query(
    "m5_predict_from_bins",
    with_pf(
        f""", f AS (SELECT *, coalesce(tax_null, avg(tax_null) OVER ()) AS t FROM pf)
        SELECT {KEYS_SQL}, {rs(f"exp({eta_sql(tax='t')})")} AS prediction FROM f"""
    ),
)
def m5(spark, sf):
    # The lookup of one number per bin equals the sum over the bins of prepared rows.
    data = pf(spark, sf)
    model = effects_model("poisson")
    ready, bins = with_bins(data, list(model.contributions), model.blueprint)
    eta = F.lit(model.intercept)
    for v, b in bins.items():
        eta = eta + F.get(F.array(*[F.lit(x) for x in EFFECTS[v]]), b)
    return ready.select(*KEYS, r(F.exp(eta)).alias("prediction"))


def _predict(family, inverse):
    @query(
        f"m6_predict_{family}",
        with_pf(
            f""", f AS (SELECT *, coalesce(tax_null, avg(tax_null) OVER ()) AS t FROM pf)
            SELECT {KEYS_SQL}, {rs(inverse.format(eta_sql(tax='t')))} AS prediction FROM f"""
        ),
    )
    def run(spark, sf):
        scored = predict_with_model(effects_model(family), pf(spark, sf))
        return scored.select(*KEYS, r("prediction").alias("prediction"))

    return run


for _family, _inverse in (
    ("poisson", "exp({})"), ("binomial", "1 / (1 + exp(-({})))"), ("gaussian", "{}"),
):
    _predict(_family, _inverse)

PREDICTORS = ["discount", "p_size", "segment"]


def small_pipeline(data, **options):
    return PricingPipeline.fit(
        data, "ClaimNb", "Poisson", PREDICTORS, weight_col="Exposure",
        divide_target_by_weight=True, base_rate=0.1,
        **{"use_cv": False, **options},
    )


@query(
    "m7_pipeline_equals_steps",
    with_pf("SELECT segment, count(*)::BIGINT AS n, 0.0::DOUBLE AS largest_gap FROM pf GROUP BY 1"),
)
def m7(spark, sf):
    data = fit_rows(spark, sf, "poisson", PREDICTORS)
    whole = small_pipeline(data)
    plan = generate_blueprint(data.where("traintest = 1"), PREDICTORS)
    wide = prepare_data(
        PREDICTORS, ["ClaimNb", "traintest", "Exposure"], df=data, formats=plan
    )
    steps = fit_lasso_glm(
        wide, "ClaimNb", "traintest", "Poisson", "Exposure", divide_target_by_weight=True,
        use_cv=False,
    )
    both = prepare_data(
        PREDICTORS, ["p1", *PREDICTORS], df=whole.predict(data, "p1"), formats=plan
    )
    scored = steps.predict(both, "p2")
    gap = F.max(F.abs(F.col("p1") - F.col("p2")))
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), r(gap, 5).alias("largest_gap")
    )


@query(
    "m8_parameter_counts",
    with_pf(
        f""", {quantile_sql(['discount', 'p_size'])}
        SELECT variable, count(*)::BIGINT AS n_params FROM brk GROUP BY 1
        UNION ALL SELECT 'segment', count(DISTINCT segment) + 1 FROM pf
        UNION ALL SELECT '(Intercept)', 1"""
    ),
)
def m8(spark, sf):
    model = small_pipeline(fit_rows(spark, sf, "poisson", PREDICTORS)).model
    return model.coefficients(spark).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_params")
    )


@query(
    "p16_feature_set",
    """SELECT unnest(['discount', 'p_size', 'segment_lumped[' || s || ']']) AS feature FROM
    (SELECT DISTINCT c_mktsegment AS s FROM customer UNION ALL SELECT 'Other') GROUP BY 1""",
)
def p16(spark, sf):
    """Every column of the prepared table but target, flag and weight."""
    table = fit_rows(spark, sf, "poisson", PREDICTORS)
    model = fit_lasso_glm(
        table, "ClaimNb", "traintest", "Poisson", "Exposure", use_cv=False
    )
    return model.coefficients(spark).where("ord > 0").select("feature")


@query(
    "m9_summary",
    """SELECT 'Poisson' AS model_type, 'ClaimNb' AS target, 'Exposure' AS weight_col,
    'traintest' AS train_test_col, 'discount,p_size,segment' AS predictors, 0.1::DOUBLE AS base_rate,
    3 AS num_variables, 1 AS snapshots FROM lineitem LIMIT 1""",
)
def m9(spark, sf):
    table = small_pipeline(fit_rows(spark, sf, "poisson", PREDICTORS)).summary_table(spark)
    return table.withColumn("predictors", F.concat_ws(",", "predictors"))


@query(
    "s6_pipeline_store",
    with_pf("SELECT segment, count(*)::BIGINT AS n, 0.0::DOUBLE AS largest_gap FROM pf GROUP BY 1"),
)
def s6(spark, sf):
    data = fit_rows(spark, sf, "poisson", PREDICTORS)
    saved = small_pipeline(data)
    path = scratch_path(spark, "pipeline")
    saved.save(spark, path)
    loaded = PricingPipeline.load(spark, path)
    scored = loaded.predict(saved.predict(data, "p1"), "p2")
    scored = loaded.rate_model.predict(
        saved.rate_model.predict(scored, output_col="t1"), output_col="t2"
    )
    gap = F.greatest(F.abs(F.col("p1") - F.col("p2")), F.abs(F.col("t1") - F.col("t2")))
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), r(F.max(gap), 9).alias("largest_gap")
    )


@query("m10_method_comparison")
def m10(spark, sf):
    return compare_methods(
        pf(spark, sf), "ClaimNb", "Poisson", PREDICTORS, name="claims", weight_col="Exposure",
        methods=METHODS,
    )


@query(
    "m10_reported_methods",
    """SELECT unnest(['elastic net (no CV)', 'GLM']) AS "Method", 1 + 1 +
    (SELECT count(DISTINCT c_mktsegment) - 1 FROM customer)::BIGINT AS n_features""",
)
def m10_methods(spark, sf):
    report = compare_methods(
        pf(spark, sf), "severity", "Gamma", PREDICTORS, methods=[METHODS[0], METHODS[2]],
    )
    # The one counts features with the level outside the plan, the other the intercept.
    return report.select("Method", (F.col("NParams") - 1).cast("bigint").alias("n_features"))
