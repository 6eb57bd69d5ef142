"""Rate tables: what a model predicts per level of one predictor, all else fixed."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.names import column
from premia.operators.blueprint import Blueprint, as_blueprint
from premia.operators.glm import GlmModel
from premia.session import local_table

# What a ``prepare`` function has to pass through, so that predictions find their level.
LEVEL_COLUMN = "rate_level"
# Families whose mean is the exponential of the linear predictor.
LOG_LINK = ("poisson", "gamma")
RATE_COLUMNS = ("variable", "kind", "ord", "break", "level", "prediction", "relativity")


def reference_row(
    df: DataFrame, columns: Sequence[str], key: Column | None = None
) -> Column:
    """One row of the data as a struct: that of the smallest key, or of the smallest hash.

    The choice does not depend on how the data is partitioned.  It matters only under
    links other than the log.
    """
    if key is None:
        key = F.xxhash64(*[column(c) for c in columns])
    fields = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # The values break ties between equal keys.
    return df.agg(F.min(F.struct(key.alias("k"), fields.alias("v"))).alias("r")).scalar()


def any_reference(model: GlmModel, df: DataFrame, columns: Sequence[str]) -> Column:
    """A row to hold everything else fixed at, for relativities alone.

    Under the log link every row gives the same ones, so nothing is read.  Under other links
    it is a row of the data.
    """
    if model.family not in LOG_LINK:
        return reference_row(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [F.lit(None).cast(types[c]).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.struct(F.lit(0).alias("k"), F.struct(*fields).alias("v"))


def with_reference(
    levels: DataFrame, reference: Column, columns: Sequence[str], override: Mapping[str, Column]
) -> DataFrame:
    """Every level row completed by the reference row, some columns overridden."""
    row = F.col("__ref").getField("v")
    values = [
        override.get(c, row.getField(f"c{i}")).alias(c) for i, c in enumerate(columns)
    ]
    kept = [column(c) for c in levels.columns]
    return levels.withColumn("__ref", reference).select(*kept, *values)


def _model_columns(model: GlmModel) -> list[str]:
    return [*model.contributions, *model.raw_slopes]


def ratetable(
    model: GlmModel,
    dataset: DataFrame,
    col_name: str,
    levels: Sequence,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    reference: Column | None = None,
    include_raw: bool = True,
) -> DataFrame:
    """``(col_name, relativity[, prediction])`` sorted by level.

    The relativity is the prediction over the median prediction of the table; null where
    that median is zero.
    """
    if not isinstance(col_name, str):
        raise TypeError(f"A predictor is named by text, not {type(col_name).__name__}.")
    if isinstance(levels, str) or not isinstance(levels, Sequence):
        raise TypeError("The levels of a rate table come as a list.")
    spark = dataset.sparkSession
    columns = dataset.columns if prepare else list(
        dict.fromkeys([*_model_columns(model), col_name])
    )
    if reference is None:
        plain = prepare is None and not include_raw
        reference = any_reference(model, dataset, columns) if plain else reference_row(dataset, columns)
    text = any(isinstance(x, str) for x in levels)
    rows = [(i, str(x) if text else float(x)) for i, x in enumerate(levels)]
    table = local_table(spark, rows, f"__ord int, __x {'string' if text else 'double'}")
    rows = with_reference(table, reference, columns, {col_name: F.col("__x")})
    rows = rows.drop("__ord").withColumnRenamed("__x", LEVEL_COLUMN)
    if prepare is not None:
        rows = prepare(rows)
        if LEVEL_COLUMN not in rows.columns:
            raise ValueError(f"prepare must keep the column '{LEVEL_COLUMN}'")
    scored = model.predict(rows, "prediction", fill={}).select(
        F.col(LEVEL_COLUMN).alias(col_name), "prediction"
    )
    median = Window.partitionBy(F.lit(1))
    relativity = F.try_divide(F.col("prediction"), F.median("prediction").over(median))
    out = scored.select(
        column(col_name),
        relativity.alias("relativity"),
        *([F.col("prediction")] if include_raw else []),
    )
    return out.orderBy(column(col_name))


def generate_all_ratetables(
    model: GlmModel,
    dataset: DataFrame,
    predictor_variables: Sequence[str],
    blueprint: Blueprint | Mapping[str, Sequence] | None = None,
    reference: Column | None = None,
    include_raw: bool = True,
) -> DataFrame:
    """Rate tables of all predictors in one table, see ``RATE_COLUMNS``.

    Its size is that of the blueprint.  A predictor without a usable plan is left out
    with a warning.  Without the predictions themselves, a model under the log link needs
    no row of the data, as all else cancels.
    """
    plans = as_blueprint(blueprint) if blueprint is not None else model.blueprint
    spark = dataset.sparkSession
    rows = []
    for v in predictor_variables:
        if not plans.usable(v):
            warnings.warn(f"'{v}' has no usable plan and gets no rate table.", stacklevel=2)
            continue
        plan = plans[v]
        rows += [(v, plan.kind, i, b, None) for i, b in enumerate(plan.breaks)]
        rows += [(v, plan.kind, i, None, lv) for i, lv in enumerate(plan.levels)]
    levels = local_table(
        spark, rows, "variable string, kind string, ord int, `break` double, level string"
    )
    for v in predictor_variables:
        if plans.usable(v) and plans[v].table is not None:
            levels = levels.unionByName(plans[v].table.table.select(
                F.lit(v).alias("variable"), F.lit("categorical").alias("kind"), F.col("ord").cast("int").alias("ord"),
                F.lit(None).cast("double").alias("break"), "level",
            ))
    columns = _model_columns(model)
    if reference is None:
        reference = reference_row(dataset, columns) if include_raw else any_reference(model, dataset, columns)
    ref = F.col("__ref").getField("v")
    filled = levels.withColumn("__ref", reference)
    values = []
    for i, c in enumerate(columns):
        own = ref.getField(f"c{i}")
        if plans.usable(c):
            given = F.col("level") if plans[c].kind == "categorical" else F.col("break")
            own = F.when(F.col("variable") == c, given).otherwise(own)
        values.append(own.alias(f"__x{i}"))
    filled = filled.select(*levels.columns, *values)
    # Predictors may be called like the columns above, so they are renamed only to score.
    keyed = filled.select(
        F.struct(*levels.columns).alias("__row"),
        *[F.col(f"__x{i}").alias(c) for i, c in enumerate(columns)],
    )
    scored = model.predict(keyed, "__p", fill={}).select("__row.*", F.col("__p").alias("prediction"))
    # The median is an aggregate of its own, as one variable may have more levels than one task should hold.
    medians = scored.groupBy(F.col("variable").alias("__of")).agg(F.median("prediction").alias("__median"))
    rated = scored.join(medians, F.col("variable") == F.col("__of")).withColumn(
        "relativity", F.try_divide(F.col("prediction"), F.col("__median"))
    )
    return rated.select(*[c for c in RATE_COLUMNS if include_raw or c != "prediction"])


def split_ratetables(rates: DataFrame, names: Sequence[str], blueprint: Blueprint) -> dict:
    """One ``(level, relativity, prediction)`` table per predictor."""
    return {
        v: rates.where(F.col("variable") == v)
        .orderBy("ord")
        .select(
            F.col("break" if blueprint[v].kind == "numeric" else "level").alias(v),
            "relativity",
            "prediction",
        )
        for v in names
        if blueprint.usable(v)
    }
