"""Several methods on one split, compared on the holdout rows."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.loss import clip_prediction, family_name, metric_aggregates
from premia.functions.names import column
from premia.functions.split import HOLDOUT_FLAG, TRAIN_FLAG
from premia.operators.blueprint import Blueprint, VariablePlan, level_counts, level_plans
from premia.operators.cells import compresses
from premia.operators.glm import fit_glm
from premia.operators.prepare import with_bins
from premia.session import ScratchTable, local_table, scratch_root

# The settings of the tree method.
GBT_ITERATIONS = 500
GBT_DEPTH = 6
GBT_STEP = 0.1
GBT_SEED = 42

REPORT_SCHEMA = (
    "Dataset string, Method string, Deviance double, RMSE double, MAE double, "
    "FitTime_s double, PredTime_s double, NParams int"
)
METHODS = ("elastic net (no CV)", "elastic net (CV)", "GLM", "boosted trees")


def _summed(rows: DataFrame) -> DataFrame:
    """Rows of equal features as one, of their total weight and weighted mean label.

    Likelihoods of one mean, and squared error up to a constant, know no more of them.  Rows that
    would hardly compress stay as they are; a null label or weight stays one and fails as before.
    """
    keys = [c for c in rows.columns if c not in ("label", "weight")]
    if not compresses(rows, keys):
        return rows
    label, weight = F.col("label"), F.col("weight")
    mean = F.coalesce(F.try_divide(F.sum(weight * label), F.sum(weight)), F.avg(label))
    parts = rows.groupBy(*keys, (label + weight).isNull().alias("__null"))
    return parts.agg(mean.alias("__label"), F.sum(weight).alias("__weight")).select(
        F.when(~F.col("__null"), F.col("__label")).alias("label"),
        F.when(~F.col("__null"), F.col("__weight")).alias("weight"),
        *keys,
    )


def _vectors(df: DataFrame, numeric, plans: Blueprint, target, weight, summed: bool) -> DataFrame:
    """Numbers and one-hot texts without their first level, as one sparse vector.

    A level's position comes from its plan, so many levels cost a lookup and no expression.
    ``summed`` lets rows of equal features become one.
    """
    df, bins = with_bins(df, list(plans), plans)
    numbers = [column(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)]
    places = []
    for i, (c, at) in enumerate(bins.items()):
        n = plans[c].size - 1
        # The encoder leaves the last position out: that of the first level and of unknown ones.
        places.append(F.when((at == 0) | (at == n), n - 1).otherwise(at - 1).cast("double").alias(f"t{i}"))
    named = df.select(
        column(target).cast("double").alias("label"),
        (column(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        *numbers,
        *places,
    )
    if summed:
        named = _summed(named)
    sized = [i for i, c in enumerate(bins) if plans[c].size > 2]
    for i, c in enumerate(bins):
        # The position's metadata says how many there are, so the encoder needs no pass over the data.
        meta = {"ml_attr": {"type": "nominal", "num_vals": max(1, plans[c].size - 1), "name": f"t{i}"}}
        named = named.withMetadata(f"t{i}", meta)
    flags = [f"f{i}" for i in sized]
    if sized:
        encoder = OneHotEncoder(inputCols=[f"t{i}" for i in sized], outputCols=flags, dropLast=True)
        named = encoder.fit(named).transform(named)
    inputs = [*(f"n{i}" for i in range(len(numeric))), *flags]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(named)


def _report(name, method, scored: DataFrame, family, fit_s, pred_start, n_params):
    p = clip_prediction(F.col("prediction"), family)
    row = scored.agg(*metric_aggregates(F.col("label"), p, family)).first()
    return (
        name,
        method,
        *[None if row[m] is None else round(row[m], 4) for m in ("deviance", "rmse", "mae")],
        round(fit_s, 3),
        round(time.perf_counter() - pred_start, 4),
        int(n_params),
    )


def compare_methods(
    df: DataFrame,
    target: str,
    model_type: str,
    predictors: Sequence[str],
    *,
    name: str = "data",
    weight_col: str | None = None,
    train_test_col: str = "traintest",
    methods: Sequence[str] = METHODS,
    cv_params: dict | None = None,
    gbt_iterations: int = GBT_ITERATIONS,
) -> DataFrame:
    """One row per method with holdout deviance, RMSE, MAE, times and parameter count.

    All methods see the same features: numbers as they are, texts one-hot without the
    first level.  A method that fails gives a row of nulls.
    """
    family = family_name(model_type)
    spark = df.sparkSession
    roles = [c for c in (target, train_test_col, weight_col) if c]
    # All methods read the same rows, so an input that is a costly query runs once.
    table = ScratchTable(df.select(*[column(c) for c in dict.fromkeys([*predictors, *roles])]), "comparison")
    df = table.df
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in predictors if isinstance(types[c], T.NumericType)]
    texts = [c for c in predictors if c not in numeric]
    train = df.where(column(train_test_col) == TRAIN_FLAG)
    test = df.where(column(train_test_col) == HOLDOUT_FLAG)
    levels = level_plans(level_counts(train, texts), texts) if texts else {}
    plans = Blueprint({c: p if p.kind == "categorical" else VariablePlan("categorical") for c, p in levels.items()})

    made: dict[str, ScratchTable] = {}

    def vectors(which: str) -> DataFrame:
        """Written on first use and shared by the methods, which read it many times."""
        if which not in made:
            rows = train if which == "train" else test
            made[which] = ScratchTable(
                _vectors(rows, numeric, plans, target, weight_col, summed=which == "train"), f"vectors-{which}"
            )
        return made[which].df

    train_vectors, test_vectors = (lambda: vectors("train")), (lambda: vectors("test"))

    def net(use_cv: bool):
        start = time.perf_counter()
        model = fit_glm(
            df, target, family, predictors, plans,
            train_test_col=train_test_col, weight_col=weight_col, use_cv=use_cv,
            cv_params=cv_params if use_cv else None, drop_first=True,
        )
        took = time.perf_counter() - start
        begin = time.perf_counter()
        scored = model.predict(test).select(
            column(target).cast("double").alias("label"), "prediction"
        )
        return scored, took, begin, model.n_params

    def glm():
        start = time.perf_counter()
        link = {"gaussian": "identity", "binomial": "logit"}.get(family, "log")
        model = GeneralizedLinearRegression(
            family=family, link=link, weightCol="weight", maxIter=50
        ).fit(train_vectors())
        took = time.perf_counter() - start
        begin = time.perf_counter()
        scored = model.transform(test_vectors())
        return scored, took, begin, len(model.coefficients) + 1

    def trees():
        start = time.perf_counter()
        # Each tree starts from the errors of those before; without checkpoints their history grows with every tree.
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(scratch_root(spark))
        model = GBTRegressor(
            maxIter=gbt_iterations, maxDepth=GBT_DEPTH, stepSize=GBT_STEP, seed=GBT_SEED,
            weightCol="weight",
        ).fit(train_vectors())
        took = time.perf_counter() - start
        begin = time.perf_counter()
        scored = model.transform(test_vectors())
        if family == "poisson":
            scored = scored.withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
        return scored, took, begin, model.getNumTrees

    runs: dict[str, Callable] = {
        METHODS[0]: lambda: net(False),
        METHODS[1]: lambda: net(True),
        METHODS[2]: glm,
        METHODS[3]: trees,
    }
    rows = []
    for method in methods:
        try:
            scored, took, begin, n_params = runs[method]()
            rows.append(_report(name, method, scored, family, took, begin, n_params))
        except Exception as error:  # noqa: BLE001 - a failing method is a result
            warnings.warn(f"{method} failed: {error}", stacklevel=2)
            rows.append((name, method, *[None] * 6))
    for written in (table, *made.values()):
        written.drop()
    return local_table(spark, rows, REPORT_SCHEMA)
