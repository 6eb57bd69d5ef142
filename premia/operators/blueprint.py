"""Learn a binning plan per column: quantile breaks or retained levels."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.binning import OTHER
from premia.functions.names import column
from premia.operators.levels import LevelTable, numbered
from premia.operators.quantiles import approximate_quantiles, nearest_quantiles
from premia.session import ScratchTable, local_table

# 20 probabilities from 5 % up, each as start plus a multiple of the step.
QUANTILE_PROBABILITIES = tuple(0.05 + i * 0.05 for i in range(20))

NUMERIC_TYPES = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)
UNSUPPORTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

BLUEPRINT_SCHEMA = "variable string, kind string, ord int, `break` double, level string"

#: Up to so many kept levels of a column are a list on the driver; more stay a table.
LISTED_LEVELS = 2_000


@dataclass(frozen=True)
class VariablePlan:
    """How one column is binned.  ``kind`` is numeric, categorical, empty or error.

    A categorical column has either ``levels`` or, for many, a ``table`` of them.
    """

    kind: str
    breaks: tuple[float, ...] = ()
    levels: tuple[str, ...] = ()
    error: str | None = None
    table: LevelTable | None = None

    @property
    def size(self) -> int:
        """Number of bins: below each break and above the last, or levels and other."""
        if self.table is not None:
            return self.table.last + 1
        return len(self.breaks if self.kind == "numeric" else self.levels) + 1


class Blueprint(Mapping[str, VariablePlan]):
    """Plans by column name, in column order."""

    def __init__(self, plans: Mapping[str, VariablePlan]):
        self._plans = dict(plans)

    def __getitem__(self, name: str) -> VariablePlan:
        return self._plans[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)

    def usable(self, name: str) -> bool:
        plan = self._plans.get(name)
        return plan is not None and plan.kind in ("numeric", "categorical")

    @classmethod
    def from_lists(cls, lists: Mapping[str, Sequence]) -> Blueprint:
        """From plain lists: numbers are breaks, anything else is levels."""
        plans = {}
        for name, items in lists.items():
            if isinstance(items, VariablePlan):
                plans[name] = items
            elif isinstance(items, str):
                plans[name] = VariablePlan("error", error=items)
            elif len(items) == 0:
                plans[name] = VariablePlan("empty")
            elif all(isinstance(i, int | float) and not isinstance(i, bool) for i in items):
                plans[name] = VariablePlan(
                    "numeric", breaks=tuple(sorted({float(i) for i in items}))
                )
            else:
                if any(i is None for i in items):
                    raise ValueError("Null cannot be kept as a level.")
                plans[name] = VariablePlan(
                    "categorical", levels=tuple(dict.fromkeys(str(i) for i in items))
                )
        return cls(plans)

    def to_lists(self) -> dict[str, list | str]:
        """Plain lists; columns whose levels are a table are left out."""
        return {
            name: p.error if p.kind == "error" else list(p.breaks or p.levels)
            for name, p in self._plans.items()
            if p.table is None
        }

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for name, p in self._plans.items():
            rows += [(name, p.kind, i, b, None) for i, b in enumerate(p.breaks)]
            rows += [(name, p.kind, i, None, lv) for i, lv in enumerate(p.levels)]
            if p.kind in ("empty", "error"):
                rows.append((name, p.kind, None, None, p.error))
        out = local_table(spark, rows, BLUEPRINT_SCHEMA)
        for name, p in self._plans.items():
            if p.table is not None:
                out = out.unionByName(p.table.table.select(
                    F.lit(name).alias("variable"), F.lit(p.kind).alias("kind"), F.col("ord").cast("int").alias("ord"),
                    F.lit(None).cast("double").alias("break"), "level",
                ))
        return out

    @classmethod
    def from_dataframe(cls, df: DataFrame, order: Sequence[str] | None = None) -> Blueprint:
        counts = {r["variable"]: r["n"] for r in df.groupBy("variable").agg(F.count("level").alias("n")).collect()}
        large = [name for name, n in counts.items() if n > LISTED_LEVELS]
        grouped: dict[str, list] = {}
        for row in df.where(~F.col("variable").isin(large)).orderBy("variable", "ord").collect():
            grouped.setdefault(row["variable"], []).append(row)
        plans = {}
        for name in order if order is not None else sorted(counts):
            if name in large:
                own = df.where(F.col("variable") == name).select("level", "ord", F.lit(0.0).alias("value"))
                plans[name] = VariablePlan("categorical", table=LevelTable.write(own, 0.0))
                continue
            rows = grouped[name]
            kind = rows[0]["kind"]
            if kind == "numeric":
                plans[name] = VariablePlan(kind, breaks=tuple(r["break"] for r in rows))
            elif kind == "categorical":
                plans[name] = VariablePlan(kind, levels=tuple(r["level"] for r in rows))
            else:
                plans[name] = VariablePlan(kind, error=rows[0]["level"])
        return cls(plans)


def as_blueprint(value: Blueprint | Mapping[str, Sequence]) -> Blueprint:
    return value if isinstance(value, Blueprint) else Blueprint.from_lists(value)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, level, n)`` of the non-null texts of several columns, in one pass.

    Counting starts before the shuffle, so a level that fills a third of the table
    travels as one row per task.
    """
    pairs = [x for c in columns for x in (F.lit(c), column(c).cast("string"))]
    long = df.select(F.stack(F.lit(len(columns)), *pairs).alias("variable", "level"))
    return (
        long.where(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_plans(kept: DataFrame, columns: Sequence[str]) -> dict[str, VariablePlan]:
    """Plans from ``(variable, level)``, one row per kept level.

    Columns with up to ``LISTED_LEVELS`` levels get a sorted list, the others a written table;
    the text that stands for everything else is never a level.
    """
    found = ScratchTable(kept.where(F.col("level") != OTHER).select("variable", "level"), "kept-levels")
    counts = {r["variable"]: r["n"] for r in found.df.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed: dict[str, list[str]] = {c: [] for c in columns if counts.get(c, 0) <= LISTED_LEVELS}
    for row in found.df.where(F.col("variable").isin(list(listed))).collect():
        listed[row["variable"]].append(row["level"])
    plans = {}
    for c in columns:
        if c in listed:
            plans[c] = VariablePlan("categorical" if listed[c] else "empty", levels=tuple(sorted(listed[c])))
        else:
            own = numbered(found.df.where(F.col("variable") == c).select("level"))
            plans[c] = VariablePlan("categorical", table=LevelTable.write(own.withColumn("value", F.lit(0.0)), 0.0))
    found.drop()
    return plans


def present(name: str, data_type: T.DataType) -> Column:
    """True where a column has a value to learn from; NaN is not one."""
    x = column(name)
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return x.isNotNull() & ~F.isnan(x)
    return x.isNotNull()


def _retained_levels(
    df: DataFrame, columns: Sequence[str], threshold: float, totals: Mapping[str, int]
) -> dict[str, VariablePlan]:
    """Per column the levels whose share of the non-null rows reaches the threshold, 0 for all."""
    total = F.lit(None).cast("bigint")
    for c in columns:
        total = F.when(F.col("variable") == c, F.lit(totals[c])).otherwise(total)
    kept = level_counts(df, columns).where(
        ~(F.col("n").cast("double") / total < F.lit(float(threshold)))
    )
    return level_plans(kept, columns)


def generate_blueprint(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.0025,
    method: str = "exact",
    counts: Mapping[str, int] | None = None,
    few_values: bool = False,
) -> Blueprint:
    """Plan for every column: sorted distinct quantile breaks, or sorted levels.

    Nulls are left out first; a column with nothing else gets an empty plan.  A column
    of a type that cannot be binned gets an error plan and the others go on.  ``counts``
    gives the numbers of values per column where they are already known.  ``few_values`` says that most numeric
    columns hold few different values: the pass that counts them then settles their breaks, and only columns
    of many go on to the rounds of exact quantiles.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns) if columns is not None else df.columns
    numeric = [c for c in columns if isinstance(types[c], NUMERIC_TYPES)]
    broken = [c for c in columns if isinstance(types[c], UNSUPPORTED_TYPES)]
    textual = [c for c in columns if c not in numeric and c not in broken]

    few_values = few_values and method == "exact" and counts is None
    learned = textual if few_values else numeric + textual
    if counts is None and learned:
        row = df.agg(
            *[F.count_if(present(c, types[c])).alias(f"n{i}") for i, c in enumerate(learned)]
        ).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(learned)}
    if method == "exact":
        breaks = nearest_quantiles(df, numeric, QUANTILE_PROBABILITIES, counts=counts, few=few_values)
    elif method == "approx":
        breaks = approximate_quantiles(df, numeric, QUANTILE_PROBABILITIES)
    else:
        raise ValueError("method must be 'exact' or 'approx'")
    levels = _retained_levels(df, textual, threshold, counts) if textual else {}

    plans = {}
    for c in columns:
        if c in broken:
            message = f"Error: cannot bin a column of type {types[c].simpleString()}"
            warnings.warn(f"Column '{c}': {message}", stacklevel=2)
            plans[c] = VariablePlan("error", error=message)
        elif c in numeric:
            found = tuple(sorted(set(breaks[c])))
            plans[c] = VariablePlan("numeric" if found else "empty", breaks=found)
        else:
            plans[c] = levels[c]
    return Blueprint(plans)


# Up to this many kept levels the rewrite is an IN list; beyond it, a join.
IN_LIST_LIMIT = 1000


def lump_rare_levels(
    df: DataFrame,
    col_name: str,
    total_count: int | None = None,
    threshold: float = 0.001,
    other: str = OTHER,
) -> DataFrame:
    """Rewrite one column: levels with a share below the threshold become ``other``.

    The share is taken of all rows, nulls included, unless ``total_count`` says
    otherwise; null stays null.
    """
    x = column(col_name).cast("string")
    counts = df.groupBy(x.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    if total_count is None:
        total_count = df.count()
    common = counts.where(
        F.col("level").isNotNull()
        & ~(F.col("n").cast("double") / F.lit(float(total_count)) < F.lit(float(threshold)))
    ).select("level")
    if threshold * total_count > 0 and 1 / threshold <= IN_LIST_LIMIT:
        levels = [r[0] for r in common.limit(IN_LIST_LIMIT + 1).collect()]
        if len(levels) <= IN_LIST_LIMIT:
            keep = x.isin(levels) if levels else F.lit(False)
            return df.withColumn(
                col_name, F.when(x.isNull() | keep, x).otherwise(F.lit(other))
            )
    # Many levels: an ordinary join, which Spark broadcasts or splits by actual size.
    marked = common.select(
        F.col("level").alias("__level"), F.lit(True).alias("__common")
    )
    joined = df.join(marked, x == F.col("__level"), "left")
    rewritten = F.when(x.isNull() | F.col("__common"), x).otherwise(F.lit(other))
    return joined.withColumn(col_name, rewritten).drop("__level", "__common")
