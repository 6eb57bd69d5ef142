"""Checks before a fit: one aggregate pass, errors raised on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from premia.functions.binning import is_finite
from premia.functions.loss import family_name
from premia.functions.names import column
from premia.functions.split import HOLDOUT_FLAG, TRAIN_FLAG


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    if len(set(df.columns)) != len(df.columns):
        raise ValueError(f"Some column names occur twice: {df.columns}")
    for name in required:
        if name not in df.columns:
            raise ValueError(f"The data has no column '{name}'.")


def _bad_target(y: Column, family: str) -> Column:
    """True for a target value the family cannot take; never null."""
    d = y.cast("double")
    outside = {
        "poisson": d < 0,
        "gamma": d <= 0,
        "gaussian": F.lit(False),
        "binomial": (d < 0) | (d > 1),
    }[family]
    return ~is_finite(y) | F.coalesce(outside, F.lit(False))


def _bad_weight(w: Column) -> Column:
    return ~is_finite(w) | F.coalesce(w.cast("double") <= 0, F.lit(False))


def _bad_flag(flag: Column) -> Column:
    return F.coalesce(~flag.isin(TRAIN_FLAG, HOLDOUT_FLAG), F.lit(False))


def rule_counts(
    df: DataFrame,
    target: str,
    train_test_col: str,
    model_type: str,
    weight_col: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row: how many rows there are, and how many break each rule.

    ``extra`` aggregates ride along in the same pass.
    """
    family = family_name(model_type)
    flag = column(train_test_col)
    weight = _bad_weight(column(weight_col)) if weight_col else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flag == TRAIN_FLAG).alias("n_train"),
        F.count_if(_bad_flag(flag)).alias("bad_flag"),
        F.count_if(_bad_target(column(target), family)).alias("bad_target"),
        F.count_if(weight).alias("bad_weight"),
        *extra,
    )


def flag_report(df: DataFrame, train_test_col: str) -> DataFrame:
    """``(flag, n)``: every value of the split column that is not allowed, with its rows."""
    flag = column(train_test_col)
    return df.where(_bad_flag(flag)).groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def distinct_flags(df: DataFrame, train_test_col: str) -> DataFrame:
    flag = column(train_test_col)
    return df.where(flag.isNotNull()).select(flag.alias("flag")).distinct()


def _missing_flag(name: str) -> ValueError:
    return ValueError(
        f"The data has no split column '{name}'. It should hold {TRAIN_FLAG} for "
        f"training rows and {HOLDOUT_FLAG} for holdout rows."
    )


#: Values named in a message; ``flag_report`` has all of them.
SHOWN_FLAGS = 20


def _raise_bad_flags(df: DataFrame, name: str, shown: int = SHOWN_FLAGS) -> None:
    report = flag_report(df, name)
    n_values, n_rows = report.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = [r["flag"] for r in report.orderBy("flag").limit(shown).collect()]
    more = f" and {n_values - len(found)} more values" if n_values > len(found) else ""
    raise ValueError(
        f"Split column '{name}' may hold {TRAIN_FLAG}, {HOLDOUT_FLAG} and null; "
        f"it also holds {found}{more}, in {n_rows} rows"
    )


def _raise_no_train(name: str) -> None:
    raise ValueError(
        f"Split column '{name}' marks no row with {TRAIN_FLAG}, so there is nothing "
        "to train on."
    )


def validate_train_test_column(
    df: DataFrame, train_test_col: str, *, require_training_rows: bool = True
) -> None:
    """The flag column exists, holds only 0, 1 and null, and marks a training row."""
    if train_test_col not in df.columns:
        raise _missing_flag(train_test_col)
    flag = column(train_test_col)
    row = df.agg(
        F.count_if(_bad_flag(flag)).alias("bad"),
        F.count_if(flag == TRAIN_FLAG).alias("train"),
    ).first()
    if row["bad"]:
        _raise_bad_flags(df, train_test_col)
    if require_training_rows and not row["train"]:
        _raise_no_train(train_test_col)


def validate_fit_input(
    df: DataFrame,
    target: str,
    train_test_col: str,
    model_type: str,
    weight_col: str | None = None,
    extra: Sequence[Column] = (),
) -> Row:
    """Everything a fit asks of its input, over all rows and not only training rows.

    Returns the counts and the ``extra`` aggregates of the one pass this takes.
    """
    if train_test_col not in df.columns:
        raise _missing_flag(train_test_col)
    check_columns(df, [target, train_test_col] + ([weight_col] if weight_col else []))
    family = family_name(model_type)
    row = rule_counts(df, target, train_test_col, family, weight_col, extra).first()
    if not row["n_rows"]:
        raise ValueError("There are no rows to fit: the table is empty.")
    if row["bad_flag"]:
        _raise_bad_flags(df, train_test_col)
    if not row["n_train"]:
        _raise_no_train(train_test_col)
    if row["bad_target"]:
        wanted = {
            "poisson": "zero or more",
            "gamma": "more than zero",
            "gaussian": "a finite number",
            "binomial": "between 0 and 1",
        }[family]
        raise ValueError(
            f"A {family} target must be {wanted}; {row['bad_target']} rows are not."
        )
    if row["bad_weight"]:
        raise ValueError(
            f"Weights must be positive and finite; {row['bad_weight']} rows are not."
        )
    return row
