"""Relativity tables as DataFrames: layout, edits, versions and comparisons.

A row is a half-open range ``[from_d, to_d)`` with null for an open end, or a ``level``;
all three null is the row for everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.binning import bin_label_column

RELATIVITY_COLUMNS = (
    "variable", "kind", "ord", "from_d", "to_d", "level", "relativity",
)
RELATIVITY_SCHEMA = (
    "variable string, kind string, ord int, from_d double, to_d double, "
    "level string, relativity double"
)
DEFAULT_RELATIVITY = 1.0


def numeric_rows(plan: DataFrame, rates: DataFrame) -> DataFrame:
    """From-to rows of numeric predictors.

    ``plan`` holds ``(variable, kind, ord, break)``, ``rates`` the relativity per break.
    The open first row takes the relativity of the first break; a break without a rate
    takes 1.
    """
    own = rates.where(F.col("break").isNotNull()).select(
        F.col("variable"), F.col("break"), F.col("relativity")
    )
    breaks = plan.where(F.col("kind") == "numeric").select("variable", "ord", "break")
    rated = breaks.join(own, ["variable", "break"], "left").withColumn(
        "relativity", F.coalesce("relativity", F.lit(DEFAULT_RELATIVITY))
    )
    following = F.lead("break").over(Window.partitionBy("variable").orderBy("ord"))
    ranges = rated.select(
        "variable",
        F.lit("numeric").alias("kind"),
        (F.col("ord") + 1).cast("int").alias("ord"),
        F.col("break").alias("from_d"),
        following.alias("to_d"),
        F.lit(None).cast("string").alias("level"),
        "relativity",
    )
    first = rated.where(F.col("ord") == 0).select(
        "variable",
        F.lit("numeric").alias("kind"),
        F.lit(0).alias("ord"),
        F.lit(None).cast("double").alias("from_d"),
        F.col("break").alias("to_d"),
        F.lit(None).cast("string").alias("level"),
        "relativity",
    )
    return ranges.unionByName(first)


def categorical_rows(plan: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per kept level, and a last one with relativity 1 for everything else."""
    own = rates.where(F.col("level").isNotNull()).select("variable", "level", "relativity")
    levels = plan.where(F.col("kind") == "categorical").select("variable", "ord", "level")
    null = F.lit(None).cast("double")
    known = levels.join(own, ["variable", "level"], "left").select(
        "variable",
        F.lit("categorical").alias("kind"),
        F.col("ord").cast("int").alias("ord"),
        null.alias("from_d"),
        null.alias("to_d"),
        "level",
        F.coalesce("relativity", F.lit(DEFAULT_RELATIVITY)).alias("relativity"),
    )
    other = levels.groupBy("variable").agg(F.max("ord").alias("last")).select(
        "variable",
        F.lit("categorical").alias("kind"),
        (F.col("last") + 1).cast("int").alias("ord"),
        null.alias("from_d"),
        null.alias("to_d"),
        F.lit(None).cast("string").alias("level"),
        F.lit(DEFAULT_RELATIVITY).alias("relativity"),
    )
    return known.unionByName(other)


def relativity_rows(plan: DataFrame, rates: DataFrame) -> DataFrame:
    """The relativity table of all predictors that have both a plan and rates."""
    rated = rates.select("variable").distinct()
    both = plan.join(rated, "variable", "left_semi")
    rows = numeric_rows(both, rates).unionByName(categorical_rows(both, rates))
    return rows.select(*RELATIVITY_COLUMNS)


_BOUNDS = ("from_d", "to_d", "level")


def _same_row(left: str, right: str):
    same = F.col(f"{left}.variable") == F.col(f"{right}.variable")
    for b in _BOUNDS:
        same &= F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}"))
    return same


def apply_edits(
    relativity: DataFrame, edits: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set new relativities: ``edits`` holds variable, from_d, to_d, level, new_relativity.

    Several edits of one row apply one after another by the column ``order``, which they then
    must have, without ties.  Returns the revised table, the change log ``(.., old_relativity,
    new_relativity)`` with one line per edit, and the edits that matched no row.
    """
    keys = ["variable", *_BOUNDS, *([order] if order else [])]
    if not edits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("A row is edited twice; name a column that tells which edit comes first.")
    by = [order] if order else ["new_relativity"]
    row = Window.partitionBy("variable", *_BOUNDS)
    steps = edits.withColumn("__before", F.lag("new_relativity").over(row.orderBy(*by))).withColumn(
        "__last", F.row_number().over(row.orderBy(*[F.desc(c) for c in by])) == 1
    )
    r, e = relativity.alias("r"), steps.alias("e")
    new = F.col("e.new_relativity")
    revised = r.join(steps.where("__last").alias("e"), _same_row("r", "e"), "left").select(
        *[F.col(f"r.{c}") for c in RELATIVITY_COLUMNS[:-1]],
        F.coalesce(new, F.col("r.relativity")).alias("relativity"),
    )
    changes = r.join(e, _same_row("r", "e")).select(
        F.col("r.variable"),
        *[F.col(f"r.{b}") for b in _BOUNDS],
        F.coalesce("e.__before", "r.relativity").alias("old_relativity"),
        new.alias("new_relativity"),
    )
    unmatched = edits.alias("e").join(r, _same_row("r", "e"), "left_anti")
    return revised, changes, unmatched


def relativities_at(versions: DataFrame, version: int) -> DataFrame:
    return versions.where(F.col("version") == version).drop("version")


def diff_versions(versions: DataFrame, v1: int, v2: int) -> DataFrame:
    """Rows whose relativity differs between two versions, or that only one has.

    Values are compared exactly, so versions that come from sums must have been written:
    a plan run once for each side may give the same sum with other last digits.
    """
    a = relativities_at(versions, v1).alias("a")
    b = relativities_at(versions, v2).alias("b")
    old, new = F.col("a.relativity"), F.col("b.relativity")
    return a.join(b, _same_row("a", "b"), "full").where(~old.eqNullSafe(new)).select(
        F.coalesce("a.variable", "b.variable").alias("variable"),
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in _BOUNDS],
        old.alias("old_relativity"),
        new.alias("new_relativity"),
    )


def comparison_table(original: DataFrame, revised: DataFrame) -> DataFrame:
    """``(variable, ord, label, original, revised)`` aligned row by row."""
    a, b = original.alias("a"), revised.alias("b")
    key = (F.col("a.variable") == F.col("b.variable")) & (F.col("a.ord") == F.col("b.ord"))
    return a.join(b, key).select(
        F.col("a.variable"),
        F.col("a.ord"),
        bin_label_column(F.col("a.from_d"), F.col("a.to_d"), F.col("a.level")).alias("label"),
        F.col("a.relativity").alias("original"),
        F.col("b.relativity").alias("revised"),
    )


def signal_variables(relativity: DataFrame, digits: int = 5) -> DataFrame:
    """Variables whose relativities are not all equal after rounding."""
    return (
        relativity.groupBy("variable")
        .agg(F.countDistinct(F.bround("relativity", digits)).alias("n_distinct"))
        .where(F.col("n_distinct") > 1)
    )
