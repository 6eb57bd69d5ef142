"""A store of tariff versions as tables, and a portfolio under many versions at once.

The store is a folder that only grows: ``rates`` has the rows of every version, one folder
each, and ``log`` one row per version.  A version is listed, read and compared by filters, so
none of this depends on the driver's memory or on how many versions there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.binning import bin_id
from premia.functions.names import column
from premia.operators.levels import LevelTable, Lookup, attach, numbered
from premia.operators.relativities import (
    RELATIVITY_COLUMNS,
    RELATIVITY_SCHEMA,
    apply_edits,
    diff_versions,
    relativities_at,
)
from premia.session import local_table

LOG_SCHEMA = "version int, description string, written string, parent_version int, base_rate double, n_rows bigint, n_changes bigint"


class VersionStore:
    """Versions under ``path``; nothing that has been written is ever changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        log = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(log)

    def log(self) -> DataFrame:
        """One row per version, see ``LOG_SCHEMA``."""
        if not self._exists():
            return local_table(self.spark, [], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def rates(self) -> DataFrame:
        """``version`` and the relativity rows of all versions; a filter on ``version`` reads its folder only."""
        schema = f"{RELATIVITY_SCHEMA}, version int"
        if not self._exists():
            return local_table(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/rates")

    def add(self, rates: DataFrame, base_rate: float, description: str, parent: int | None = None, n_changes: int = 0) -> int:
        """Write a version and give its number.  Rows first, the log last: a version without a log entry does not exist."""
        number = (self.log().agg(F.max("version")).first()[0] or 0) + 1
        folder = f"{self.path}/rates/version={number}"
        rates.select(*RELATIVITY_COLUMNS).write.mode("overwrite").parquet(folder)
        n = self.spark.read.parquet(folder).count()
        entry = (number, description, datetime.now(timezone.utc).isoformat(), parent, float(base_rate), n, n_changes)
        local_table(self.spark, [entry], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return number

    def _entry(self, version: int):
        entry = self.log().where(F.col("version") == version).first()
        if entry is None:
            raise ValueError(f"The store has no version {version}.")
        return entry

    def edit(self, version: int, edits: DataFrame, description: str, order: str | None = None) -> int:
        """A new version: ``version`` with ``edits`` applied (see ``apply_edits``)."""
        entry = self._entry(version)
        revised, changes, unmatched = apply_edits(relativities_at(self.rates(), version), edits, order)
        missed = unmatched.count()
        if missed:
            raise ValueError(f"{missed} edits name no row of version {version}.")
        return self.add(revised, entry["base_rate"], description, version, changes.count())

    def at(self, version: int) -> DataFrame:
        """The relativity rows of a version."""
        self._entry(version)
        return relativities_at(self.rates(), version)

    def diff(self, v1: int, v2: int) -> DataFrame:
        """Rows whose relativity differs, or that only one version has; a full outer join, null-safe."""
        self._entry(v1), self._entry(v2)
        return diff_versions(self.rates().where(F.col("version").isin(v1, v2)), v1, v2)

    def totals(self, df: DataFrame, exposure: Column | None = None, versions: Sequence[int] | None = None, on_null: str = "error") -> DataFrame:
        """``(version, total)`` of a portfolio under all versions, or some; see ``version_totals``."""
        rates, log = self.rates(), self.log()
        if versions is not None:
            rates, log = (t.where(F.col("version").isin(list(versions))) for t in (rates, log))
        return version_totals(df, rates, log.select("version", "base_rate"), exposure, on_null)


def version_totals(
    df: DataFrame, rates: DataFrame, bases: DataFrame, exposure: Column | None = None, on_null: str = "error"
) -> DataFrame:
    """``(version, total)``: premiums of one portfolio under any number of versions.

    The portfolio is read once and summed to cells: one per combination of the elementary
    ranges (between neighbouring breaks of any version) and levels of all variables.  Cells
    then meet each variable's rows by (version, place), so no expression grows with the
    versions.  Versions may have breaks, levels and variables of their own; a variable that a version lacks
    counts as 1.  A number that falls in no range is an error, or with ``on_null="null"`` its
    rows count for nothing in that version.
    """
    if on_null not in ("error", "null"):
        raise ValueError("on_null must be 'error' or 'null'")
    kinds = {r["variable"]: r["kind"] for r in rates.select("variable", "kind").distinct().collect()}
    missing = [v for v in kinds if v not in df.columns]
    if missing:
        raise ValueError(f"The data lacks the rating variable '{missing[0]}'.")
    spark, places, tables = df.sparkSession, {}, {}
    lookups = []
    for i, (v, kind) in enumerate(sorted(kinds.items())):
        own = rates.where(F.col("variable") == v)
        if kind == "numeric":
            x = column(v).cast("double")
            # Breaks are as many as ranges: a tariff's, and not the data's.
            breaks = sorted(r[0] for r in own.where("from_d IS NOT NULL").select("from_d").union(
                own.where("to_d IS NOT NULL").select("to_d")).distinct().collect())
            places[v] = bin_id(x, breaks, nan_is_null=True)
            low = F.when(F.col("from_d").isNull(), F.lit(0)).otherwise(bin_id(F.col("from_d"), breaks))
            high = F.when(F.col("to_d").isNull(), F.lit(len(breaks))).otherwise(bin_id(F.col("to_d"), breaks) - 1)
            tables[v] = own.select("version", "relativity", F.explode(F.sequence(low, high)).alias("place"))
        else:
            levels = own.where(F.col("level").isNotNull()).select("level").distinct()
            placed = LevelTable.write(numbered(levels).withColumn("value", F.lit(0.0)), 0.0)
            lookups.append(Lookup(column(v), placed, {f"__place_{i}": "ord"}))
            places[v] = F.col(f"__place_{i}")
            known = own.select("version", "level", "relativity").join(placed.table.select("level", "ord"), "level")
            tables[v] = known.select("version", "relativity", F.col("ord").cast("int").alias("place"))
    names = list(places)
    amount = F.lit(1.0) if exposure is None else exposure.cast("double")
    cells = (
        attach(df.withColumn("__amount", amount), lookups)
        .select(*[places[v].alias(f"p{i}") for i, v in enumerate(names)], "__amount")
        .groupBy(*[f"p{i}" for i in range(len(names))]).agg(F.sum("__amount").alias("amount"))
    )
    numeric = [i for i, v in enumerate(names) if kinds[v] == "numeric"]
    if on_null == "error":
        for i in numeric:
            message = F.lit(f"A value of '{names[i]}' falls in no bin (null or NaN).")
            cells = cells.withColumn(f"p{i}", F.coalesce(f"p{i}", F.raise_error(message).cast("int")))
    # The versions are the question asked; each cell answers it once per version.
    rated = cells.crossJoin(F.broadcast(bases)).withColumn("premium", F.col("amount") * F.col("base_rate"))
    for i, v in enumerate(names):
        rows = tables[v].select(F.col("version").alias("__version"), F.col("place").alias("__place"), F.col("relativity").alias("__rel"))
        # A version's row for everything else, and whether it has the variable at all.
        rest = rates.where(F.col("variable") == v).groupBy(F.col("version").alias("__v")).agg(
            F.max(F.when(F.col("from_d").isNull() & F.col("to_d").isNull() & F.col("level").isNull(), F.col("relativity"))).alias("__other")
        )
        rated = rated.join(rows, [F.col(f"p{i}") == F.col("__place"), F.col("version") == F.col("__version")], "left")
        rated = rated.join(F.broadcast(rest), F.col("version") == F.col("__v"), "left")
        found = F.col("__rel") if kinds[v] == "numeric" else F.coalesce("__rel", "__other", F.lit(1.0))
        factor = F.when(F.col("__v").isNull(), F.lit(1.0)).otherwise(found)
        rated = rated.withColumn("premium", F.col("premium") * factor).drop("__version", "__place", "__rel", "__v", "__other")
    return rated.groupBy("version").agg(F.sum("premium").alias("total"))
