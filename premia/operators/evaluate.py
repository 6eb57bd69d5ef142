"""Actual against expected, and error measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.binning import OTHER_LABEL
from premia.functions.loss import clip_prediction, metric_aggregates
from premia.functions.names import column
from premia.functions.split import HOLDOUT_FLAG, TRAIN_FLAG
from premia.operators.levels import LevelTable
from premia.operators.quantiles import linear_quantiles
from premia.operators.ratemodel import RateModel
from premia.session import local_table

FORMULAS = {
    "sum_weighted": "weighted mean of the value",
    "sum_unweighted": "plain mean of the value",
    "sum_over_weight": "total of the value per unit of weight",
}
OTHER_RULES = ("unmatched", "all_rows")


def _sums(values: dict[str, Column], weight: Column | None) -> list[Column]:
    """Sums from which every formula follows, for each named value."""
    out = [F.count(F.lit(1)).alias("n")]
    if weight is not None:
        out.append(F.sum(weight).alias("sw"))
    for name, v in values.items():
        out += [F.sum(v).alias(f"s_{name}"), F.count(v).alias(f"n_{name}")]
        if weight is not None:
            out.append(F.sum(v * weight).alias(f"sw_{name}"))
    return out


def _ratio(name: str, weighted: bool, formula: str) -> Column:
    if formula == "sum_weighted" and weighted:
        return F.try_divide(F.col(f"sw_{name}"), F.col("sw"))
    if formula == "sum_over_weight":
        total = F.col(f"s_{name}")
        return F.try_divide(total, F.col("sw")) if weighted else total
    return F.try_divide(F.col(f"s_{name}"), F.col(f"n_{name}"))


def _check(model: RateModel, df: DataFrame, formula: str, other: str) -> str:
    target = model.metadata.target
    if target is None:
        raise ValueError("The tariff does not say which column is its target.")
    if target not in df.columns:
        raise ValueError(f"The data lacks the target '{target}'.")
    if formula not in FORMULAS:
        raise ValueError(f"formula must be one of {sorted(FORMULAS)}")
    if other not in OTHER_RULES:
        raise ValueError(f"other must be one of {OTHER_RULES}")
    return target


def _bin_sums(
    model: RateModel,
    scored: DataFrame,
    places: dict[str, Column],
    variables: Sequence[str],
    predictions: Sequence[str],
    other: str,
) -> tuple[DataFrame, list[str], bool]:
    """Sums per (variable, row position, subset); one pass for all variables.

    Rows are summed per position and flag before anything is shuffled; the subsets are
    then put together from at most three sums per bin.
    """
    meta = model.metadata
    weighted = bool(meta.weight_col) and meta.weight_col in scored.columns
    flagged = bool(meta.train_test_col) and meta.train_test_col in scored.columns
    weight = F.col("__w") if weighted else None
    pairs = [x for i, v in enumerate(variables) for x in (F.lit(i), places[v])]
    flag = column(meta.train_test_col) if flagged else F.lit(None)
    base = scored.select(
        flag.cast("int").alias("__flag"),
        column(meta.target).cast("double").alias("actual"),
        *[column(p).alias(f"p{i}") for i, p in enumerate(predictions)],
        *([column(meta.weight_col).cast("double").alias("__w")] if weighted else []),
        F.stack(F.lit(len(variables)), *pairs).alias("v", "ord"),
    )
    values = {"actual": F.col("actual")}
    values.update({f"p{i}": F.col(f"p{i}") for i in range(len(predictions))})
    cells = (
        base.where(F.col("ord").isNotNull())
        .groupBy("v", "ord", "__flag")
        .agg(*_sums(values, weight))
    )
    if other == "all_rows":
        last = F.lit(None).cast("int")
        for i, v in enumerate(variables):
            config = model.variables[v]
            if config.kind == "categorical":
                last = F.when(F.col("v") == i, F.lit(config.last)).otherwise(last)
        # Every row also counts towards the last row of a categorical variable.
        targets = F.array_distinct(F.array_compact(F.array(F.col("ord"), last)))
        cells = cells.withColumn("ord", F.explode(targets))
    subsets = ["all", "train", "test"] if flagged else ["all"]
    own = (
        F.when(F.col("__flag") == TRAIN_FLAG, F.array(F.lit("all"), F.lit("train")))
        .when(F.col("__flag") == HOLDOUT_FLAG, F.array(F.lit("all"), F.lit("test")))
        .otherwise(F.array(F.lit("all")))
    )
    sums = [c for c in cells.columns if c not in ("v", "ord", "__flag")]
    total = (
        cells.withColumn("subset", F.explode(own))
        .groupBy("v", "ord", "subset")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    return total, subsets, weighted


def _all_bins(model: RateModel, df: DataFrame, variables, subsets) -> DataFrame:
    spark, schema = df.sparkSession, "v int, variable string, subset string, ord int, level string"
    rows = [
        (i, v, s, j, row.label)
        for i, v in enumerate(variables) if not isinstance(model.variables[v], LevelTable)
        for s in subsets
        for j, row in enumerate(model.variables[v].rows)
    ]
    out = local_table(spark, rows, schema)
    for i, v in enumerate(variables):
        config = model.variables[v]
        if isinstance(config, LevelTable):
            last = local_table(spark, [(config.last, OTHER_LABEL)], "ord bigint, level string")
            own = config.table.select("ord", "level").unionByName(last)
            out = out.unionByName(own.select(
                F.lit(i).alias("v"), F.lit(v).alias("variable"), F.explode(F.array(*map(F.lit, subsets))).alias("subset"),
                F.col("ord").cast("int").alias("ord"), "level",
            ))
    return out


def actual_expected(
    model: RateModel,
    df: DataFrame,
    variables: Sequence[str] | None = None,
    formula: str = "sum_weighted",
    *,
    other: str = "unmatched",
    on_null: str = "error",
) -> DataFrame:
    """``(variable, subset, ord, level, actual, expected, exposure)`` for all bins.

    Bins without rows show zeros.  The row for everything else holds the rows no other
    row takes, or with ``other="all_rows"`` all rows of the subset.
    """
    _check(model, df, formula, other)
    variables = list(variables) if variables is not None else list(model.variables)
    scored, places = model.predict_placed(df, variables, on_null=on_null, output_col="__pred")
    total, subsets, weighted = _bin_sums(model, scored, places, variables, ["__pred"], other)
    zero = F.lit(0.0)
    exposure = F.col("sw" if weighted else "n").cast("double")
    return (
        _all_bins(model, df, variables, subsets)
        .join(total, ["v", "ord", "subset"], "left")
        .select(
            "variable",
            "subset",
            "ord",
            "level",
            F.coalesce(_ratio("actual", weighted, formula), zero).alias("actual"),
            F.coalesce(_ratio("p0", weighted, formula), zero).alias("expected"),
            F.coalesce(exposure, zero).alias("exposure"),
        )
    )


def compute_actual_expected(
    model: RateModel, df: DataFrame, variable: str, formula: str = "sum_weighted", **options
) -> DataFrame:
    """``actual_expected`` of one variable."""
    if variable not in model.variables:
        raise KeyError(f"The tariff has no variable '{variable}'")
    return actual_expected(model, df, [variable], formula, **options)


def compare_actual_expected(
    base: RateModel,
    revised: RateModel,
    df: DataFrame,
    variables: Sequence[str] | None = None,
    formula: str = "sum_weighted",
    *,
    other: str = "unmatched",
    on_null: str = "error",
) -> DataFrame:
    """Actual and both expectations per bin of the base tariff, scored in one pass.

    Of the training rows if the data has a flag, else of all rows.
    """
    _check(base, df, formula, other)
    variables = list(variables) if variables is not None else list(base.variables)
    scored, places = base.predict_placed(df, variables, on_null=on_null, output_col="__base")
    scored = revised.predict(scored, on_null=on_null, output_col="__revised")
    total, subsets, weighted = _bin_sums(base, scored, places, variables, ["__base", "__revised"], other)
    shown = "train" if "train" in subsets else "all"
    zero = F.lit(0.0)
    return (
        _all_bins(base, df, variables, [shown])
        .join(total, ["v", "ord", "subset"], "left")
        .select(
            "variable",
            "ord",
            "level",
            F.coalesce(_ratio("actual", weighted, formula), zero).alias("actual"),
            F.coalesce(_ratio("p0", weighted, formula), zero).alias("expected_base"),
            F.coalesce(_ratio("p1", weighted, formula), zero).alias("expected_revised"),
            F.coalesce(F.col("sw" if weighted else "n").cast("double"), zero).alias("exposure"),
        )
    )


def overall_ratio(
    df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """``actual``, ``expected`` and their ratio ``ae``, in total or per group."""
    sums = df.groupBy(*[column(c) for c in by]).agg(
        F.sum(column(target).cast("double")).alias("actual"),
        F.sum(column(prediction)).alias("expected"),
    )
    return sums.withColumn("ae", F.try_divide(F.col("actual"), F.col("expected")))


def _closed_right_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges strictly below x: intervals are closed on the right."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(edges[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return F.when(x.isNotNull(), build(0, len(edges)))


def ratio_by_group(
    df: DataFrame,
    variable: str,
    target: str,
    prediction: str,
    weight_col: str,
    quantiles: int = 10,
) -> DataFrame:
    """Actual and expected per unit of weight by quantile group or by level.

    ``(grouping, lower, upper, level, actual, expected, exposure, mid, exposure_share)``;
    groups of a number are closed on the right, equal edges count once.
    """
    kind = df.schema[variable].dataType.typeName()
    numeric = kind in ("float", "double", "integer", "long", "short", "byte")
    w = column(weight_col).cast("double")
    if numeric:
        probs = [i / quantiles for i in range(1, quantiles)]
        edges = sorted(set(linear_quantiles(df, [variable], probs)[variable]))
        x = column(variable).cast("double")
        x = F.when(~F.isnan(x), x)
        group = _closed_right_bin(x, edges)
        bounds = [-math.inf, *edges, math.inf]
        lower = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("grouping"))
        upper = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("grouping") + 1)
        level, mid = F.lit(None).cast("string"), F.avg("__x")
    else:
        x = F.lit(None).cast("double")
        group = column(variable).cast("string")
        lower = upper = F.lit(None).cast("double")
        level, mid = F.col("grouping"), F.lit(None).cast("double")
    grouped = (
        df.select(
            group.alias("grouping"),
            x.alias("__x"),
            column(target).cast("double").alias("__y"),
            column(prediction).alias("__p"),
            w.alias("__w"),
        )
        .groupBy("grouping")
        .agg(
            F.try_divide(F.sum("__y"), F.sum("__w")).alias("actual"),
            F.try_divide(F.sum("__p"), F.sum("__w")).alias("expected"),
            F.sum("__w").alias("exposure"),
            mid.alias("mid"),
        )
    )
    # Of the groups, which are few, and not of the rows once more.
    total = F.sum("exposure").over(Window.partitionBy(F.lit(0)))
    return grouped.select(
        "grouping",
        lower.alias("lower"),
        upper.alias("upper"),
        level.alias("level"),
        "actual",
        "expected",
        "exposure",
        "mid",
        F.try_divide(F.col("exposure"), total).alias("exposure_share"),
    )


def evaluate(
    df: DataFrame,
    target: str,
    prediction: str,
    family: str,
    by: Sequence[str] = (),
    clip: bool = True,
) -> DataFrame:
    """Deviance, RMSE and MAE in one aggregate, in total or per group."""
    y = column(target).cast("double")
    p = column(prediction).cast("double")
    if clip:
        p = clip_prediction(p, family)
    return df.groupBy(*[column(c) for c in by]).agg(*metric_aggregates(y, p, family))
