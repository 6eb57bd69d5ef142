"""Turn raw rows into model features with one projection.

Two encodings: ``wide`` gives the 0/1 and lumped-text columns, ``bins`` gives one small
integer per predictor, which is what the fit, the scoring and the reports use.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.binning import OTHER, bin_id, break_name, level_id, lump_fun, o_matrix
from premia.functions.names import column
from premia.operators.blueprint import Blueprint, VariablePlan, as_blueprint
from premia.operators.levels import Lookup, attach


def batch_means(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """The mean of each column over the whole batch, as scalar subqueries.

    All of them read one aggregate row, so the batch is scanned once for all means.
    """
    if not names:
        return {}
    if df.isStreaming:
        raise ValueError("A stream has no batch mean; pass training means as `fill`.")
    row = df.agg(F.struct(*mean_aggregates(names)).alias("means"))
    means = row.scalar()
    return {c: means.getField(f"m{i}") for i, c in enumerate(names)}


def mean_aggregates(names: Sequence[str]) -> list[Column]:
    return [F.avg(column(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]


def mean_values(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    """The same means as numbers, for a model that keeps them."""
    if not names:
        return {}
    row = df.agg(*mean_aggregates(names)).first()
    return {c: row[f"m{i}"] for i, c in enumerate(names)}


def fill_nulls(
    df: DataFrame, names: Sequence[str], fill: str | Mapping[str, float | None]
) -> tuple[DataFrame, dict[str, Column]]:
    """Add filled copies of the numeric columns; ``fill`` is ``"batch"`` or given values.

    The copy is a column of its own, so a bin lookup that compares it many times does
    not repeat the mean.
    """
    if isinstance(fill, str):
        if fill != "batch":
            raise ValueError("fill must be 'batch' or a mapping of values")
        nullable = {f.name for f in df.schema.fields if f.nullable}
        fills = batch_means(df, [c for c in names if c in nullable])
    else:
        fills = {c: F.lit(float(fill[c])) for c in names if fill.get(c) is not None}
    if not fills:
        return df, {}
    copies = {c: f"__filled_{i}" for i, c in enumerate(fills)}
    filled = df.withColumns(
        {copies[c]: F.coalesce(column(c).cast("double"), fills[c]) for c in fills}
    )
    return filled, {c: F.col(copies[c]) for c in fills}


def variable_bin(name: str, plan: VariablePlan, x: Column | None = None) -> Column:
    """Bin id of one predictor; a null that nothing fills goes to the last bin."""
    if plan.kind == "numeric":
        x = column(name).cast("double") if x is None else x
        return F.coalesce(bin_id(x, plan.breaks), F.lit(len(plan.breaks)))
    if plan.table is not None:
        raise ValueError(f"'{name}' has a table of levels; its bins come by a join (with_bins).")
    return level_id(column(name), plan.levels)


def with_level_tables(
    df: DataFrame, names: Sequence[str], blueprint: Blueprint
) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a bin id for each predictor whose levels are a table, and these by name."""
    large = [n for n in names if n in blueprint and blueprint[n].table is not None]
    own = {n: f"__level_bin_{i}" for i, n in enumerate(large)}
    out = attach(df, [Lookup(column(n), blueprint[n].table, {own[n]: "ord"}) for n in large])
    return out, {n: F.col(c) for n, c in own.items()}


def with_bins(
    df: DataFrame,
    names: Sequence[str],
    blueprint: Blueprint,
    fill: str | Mapping[str, float | None] = "batch",
) -> tuple[DataFrame, dict[str, Column]]:
    """The batch ready for binning, and the bin id of each predictor over it."""
    numeric = [n for n in names if blueprint[n].kind == "numeric"]
    df, filled = fill_nulls(df, numeric, fill)
    df, found = with_level_tables(df, names, blueprint)
    return df, {n: found[n] if n in found else variable_bin(n, blueprint[n], filled.get(n)) for n in names}


def prepare_data(
    modelling_variables: Sequence[str],
    additional_columns: Sequence[str] | None = None,
    traintest_column: str | None = None,
    df: DataFrame | str | None = None,
    formats: Blueprint | Mapping[str, Sequence] | None = None,
    *,
    encoding: str = "wide",
    fill: str | Mapping[str, float | None] = "batch",
    spark: SparkSession | None = None,
) -> DataFrame:
    """Prepared table of a batch, given as a DataFrame or the name of a table or view.

    A predictor without a plan passes through; one with an empty plan is skipped, as is
    one the table does not have.
    """
    if isinstance(df, str):
        spark = spark or SparkSession.active()
        if not spark.catalog.tableExists(df):
            tables = ", ".join(t.name for t in spark.catalog.listTables())
            raise ValueError(
                f"There is no table or view '{df}'; there are: {tables}"
            )
        df = spark.table(df)
    if encoding not in ("wide", "bins"):
        raise ValueError("encoding must be 'wide' or 'bins'")
    blueprint = as_blueprint(formats or {})
    extra = list(additional_columns or [])
    if traintest_column and traintest_column not in extra:
        extra.append(traintest_column)

    known = []
    for name in modelling_variables:
        if name in df.columns:
            known.append(name)
        else:
            warnings.warn(f"The table has no predictor '{name}'; left out.", stacklevel=2)
    numeric = [n for n in known if n in blueprint and blueprint[n].kind == "numeric"]
    df, filled = fill_nulls(df, numeric, fill)
    df, found = with_level_tables(df, known, blueprint)

    out: list[Column] = []
    names: list[str] = []
    for name in known:
        if name not in blueprint:
            out.append(column(name))
            names.append(name)
            continue
        plan = blueprint[name]
        if plan.kind == "error":
            raise ValueError(f"Column '{name}' has no usable plan: {plan.error}")
        if plan.kind == "empty":
            continue
        if encoding == "bins":
            at = found[name] if name in found else variable_bin(name, plan, filled.get(name))
            out.append(at.alias(f"{name}_bin"))
            names.append(f"{name}_bin")
        elif plan.kind == "numeric":
            out += o_matrix(name, list(plan.breaks), filled.get(name))
            names += [break_name(name, b) for b in plan.breaks]
        else:
            if name in found:
                kept = F.when(found[name] < plan.table.last, column(name).cast("string"))
                out.append(F.coalesce(kept, F.lit(OTHER)).alias(f"{name}_lumped"))
            else:
                out.append(lump_fun(name, plan.levels))
            names.append(f"{name}_lumped")
    for name in extra:
        if name in df.columns:
            out.append(column(name))
            names.append(name)
        else:
            warnings.warn(
                f"The table has no column '{name}' to pass on; left out.", stacklevel=2
            )
    if not out:
        return df.limit(0).select()
    if len(set(names)) != len(names):
        twice = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"Prepared columns would share a name: {twice}")
    return df.select(*out)


def one_hot(
    df: DataFrame,
    col_name: str,
    levels: Sequence[str],
    drop_first: bool = False,
    prefix: str | None = None,
) -> DataFrame:
    """Add one 0/1 column per level, the first left out on request."""
    x = column(col_name).cast("string")
    prefix = col_name if prefix is None else prefix
    kept = list(levels)[1:] if drop_first else list(levels)
    return df.withColumns(
        {
            f"{prefix}_{lv}": F.when(x == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
            for lv in kept
        }
    )
