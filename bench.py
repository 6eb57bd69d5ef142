"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from premia import (  # noqa: E402
    RateModel,
    actual_expected,
    evaluate,
    fit_glm,
    generate_blueprint,
    prepare_data,
    ratio_by_group,
)
from premia.plans.portfolio import portfolio  # noqa: E402
from premia.session import ScratchTable  # noqa: E402
from workload.tariffs import revised_tariff, tariff  # noqa: E402

PREDICTORS = ["discount", "tax_null", "p_size", "price", "segment", "brand"]
ROLES = {"weight_col": "Exposure", "divide_target_by_weight": True}


WIDE = 26


def fit_wide(data):
    """A fit of 32 predictors with about 600 features by active sets, plan included."""
    extra = {
        f"x{i}_": ((F.col("l_orderkey") * (2 * i + 3) + F.col("l_linenumber") * (i + 5) + F.col("l_partkey")) % (40 + i)).cast("double")
        for i in range(WIDE)
    }
    wide = data.withColumns(extra)
    names = [*PREDICTORS, *extra]
    plan = generate_blueprint(wide.where("traintest = 1"), names, method="approx")
    return fit_glm(wide, "ClaimNb", "Poisson", names, plan, use_cv=False, alpha=2e-3, cv_params={"solver": "active"}, **ROLES)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    kept: dict = {}

    def run(name, fn):
        start = time.perf_counter()
        kept[name] = fn()
        times[name] = round(time.perf_counter() - start, 3)

    # The first job pays for starting the workers and the compiler.
    run("warm_up", lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect())
    run("portfolio_join", lambda: ScratchTable(portfolio(spark, sf_dir), "portfolio", spread=True))
    data = kept["portfolio_join"].df
    train = data.where("traintest = 1")

    run("blueprint_exact", lambda: generate_blueprint(train, PREDICTORS))
    run("blueprint_approx", lambda: generate_blueprint(train, PREDICTORS, method="approx"))
    plan = kept["blueprint_exact"]

    def wide():
        table = prepare_data(PREDICTORS, ["ClaimNb", "traintest"], df=data, formats=plan)
        table.write.format("noop").mode("overwrite").save()

    run("prepare_wide", wide)

    def fit(family, target, **options):
        return fit_glm(data, target, family, PREDICTORS, plan, **{**ROLES, **options})

    run("fit_poisson_no_cv", lambda: fit("Poisson", "ClaimNb", use_cv=False))
    run(
        "fit_poisson_cv_small_grid",
        lambda: fit("Poisson", "ClaimNb", cv_params={"n_alphas": 5, "l1_ratio": [1.0]}),
    )
    run("fit_poisson_cv_default", lambda: fit("Poisson", "ClaimNb"))
    run(
        "fit_gamma_cv_default",
        lambda: fit("Gamma", "severity", weight_col=None, divide_target_by_weight=False),
    )
    run("fit_wide_no_cv", lambda: fit_wide(data))
    model = kept["fit_poisson_no_cv"]
    run("rate_model_from_fit", lambda: RateModel.from_glm_model(model, data, plan, 0.1))

    def predict():
        model.predict(data).write.format("noop").mode("overwrite").save()

    run("predict_glm", predict)
    rates = tariff(exposure=True)
    run(
        "score_tariff",
        lambda: rates.predict(data).write.format("noop").mode("overwrite").save(),
    )
    run("score_versions", lambda: revised_tariff(exposure=True).score_versions(data).collect())
    run(
        "ae_all_variables",
        lambda: actual_expected(rates, data, formula="sum_over_weight").collect(),
    )
    scored = rates.predict(data)
    run(
        "ae_by_decile",
        lambda: ratio_by_group(scored, "price", "ClaimNb", "prediction", "Exposure").collect(),
    )
    run("metrics", lambda: evaluate(scored, "ClaimNb", "prediction", "poisson", ["traintest"]).collect())

    kept["portfolio_join"].drop()
    times.pop("warm_up")
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
