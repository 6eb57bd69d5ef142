"""Values by level for variables with more levels than an expression should hold.

A ``LevelTable`` keeps one row per level in a written table.  ``attach`` looks values of
several such variables up in one go: each is a keyed left join, so neither the plan nor the
driver grows with the number of levels.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.binning import lookup_level
from premia.session import ScratchTable, local_table

#: Up to so many levels a lookup is a balanced CASE; beyond, a join.
CASE_LEVELS = 256
#: A level with more than one in so many of the rows is heavy; so at most as many are.
HEAVY_SHARE = 256
# Levels a sketch keeps; its counts err by less than 1/6,000 of the rows.
HEAVY_TRACKED = 8_192
#: Rows without a match to find (null, heavy) are dealt out over so many keys.
SALTS = 1024
LEVEL_SCHEMA = "level string, ord bigint, value double"


@dataclass(frozen=True)
class LevelTable:
    """``(level, ord, value)``, one row per level, and the value of everything else.

    ``size`` counts the levels, ``last`` is the position of everything else, and ``width`` is
    the size in bytes, as measured.  ``edits`` are values set since the table was written, few
    enough to be literals.
    """

    table: DataFrame
    size: int
    last: int
    width: int
    fallback: float
    edits: tuple[tuple[str, float], ...] = ()

    kind = "categorical"

    @classmethod
    def write(cls, levels: DataFrame, fallback: float) -> LevelTable:
        """From a DataFrame with ``level``, ``ord`` and ``value``; levels must be distinct and not null."""
        rows = levels.select(F.col("level").cast("string"), F.col("ord").cast("bigint"), F.col("value").cast("double"))
        return cls.read(ScratchTable(rows, "levels").df, fallback)

    @classmethod
    def read(cls, table: DataFrame, fallback: float) -> LevelTable:
        seen = table.agg(
            F.count(F.lit(1)).alias("n"), F.max("ord").alias("ord"), F.sum(F.octet_length("level") + 32).alias("width"),
            F.count_if(F.col("level").isNull()).alias("nulls"),
        ).first()
        if seen["nulls"]:
            raise ValueError("Null cannot be a level of a table; it takes the value of everything else.")
        if not table.groupBy("level").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError("A table of levels must have each level once.")
        return cls(table, seen["n"], (-1 if seen["ord"] is None else seen["ord"]) + 1, int(seen["width"] or 0), float(fallback))

    def edited(self, level: str | None, value: float) -> LevelTable:
        """With another value for one level, or with ``level=None`` for everything else."""
        if level is None:
            return replace(self, fallback=float(value))
        kept = tuple(e for e in self.edits if e[0] != level)
        return replace(self, edits=(*kept, (level, float(value))))

    def value_of(self, level: str | None) -> float | None:
        """The value of one level; None where the table does not have it."""
        if level is None:
            return self.fallback
        for lv, value in self.edits:
            if lv == level:
                return value
        row = self.table.where(F.col("level") == level).select("value").first()
        return None if row is None else row[0]

    def rows(self) -> DataFrame:
        """The table as of now."""
        if not self.edits:
            return self.table
        values = {lv: F.lit(v) for lv, v in self.edits}
        return self.table.withColumn("value", lookup_level(F.col("level"), values, F.col("value")))


@dataclass(frozen=True)
class Lookup:
    """One lookup of ``source`` in ``table``; ``out`` says by column name what is wanted, ``value`` or ``ord``."""

    source: Column
    table: LevelTable
    out: Mapping[str, str]


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session lets a join side be broadcast."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    match = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", text)
    if match is None:
        return 0
    return max(0, int(match[1]) << (10 * " kmgtp".index(match[2] or " ")))


def heavy_levels(df: DataFrame, sources: Sequence[Column]) -> list[list[str]]:
    """Per source the levels that hold more than 1/``HEAVY_SHARE`` of all rows; one pass for all.

    A sketch of frequent levels per task, so what is shuffled does not grow with rows or levels.  It
    misses none of that share, and which rows are spread never shows in a result.
    """
    keyed = df.select(*[s.cast("string").alias(f"k{i}") for i, s in enumerate(sources)])
    tops = [F.expr(f"approx_top_k(k{i}, {HEAVY_SHARE + 1}, {HEAVY_TRACKED})").alias(f"t{i}") for i in range(len(sources))]
    row = keyed.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    limit = row["n"] / HEAVY_SHARE
    return [[x["item"] for x in row[f"t{i}"] if x["item"] is not None and x["count"] > limit] for i in range(len(sources))]


def _salt(df: DataFrame) -> Column:
    """Spreads rows over tasks; which row gets which value never shows in a result."""
    if not df.isStreaming:
        return 1 + F.monotonically_increasing_id() % SALTS
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return 1 + F.pmod(F.xxhash64(*plain), F.lit(SALTS))


def attach(df: DataFrame, lookups: Sequence[Lookup], heavy: bool = True) -> DataFrame:
    """``df`` with the columns that every lookup names; no row is lost or doubled.

    A table whose measured size is within the session's limit is broadcast, so ``df`` stays
    where it is.  A larger one is joined by key: null, which matches nothing, and heavy levels
    get keys of their own, spread over many tasks, and the few values of heavy levels are
    literals.  A level that the table lacks, and null, give the fallback and ``last`` as ``ord``.
    ``heavy=False`` saves the pass that finds heavy levels.
    """
    if not lookups:
        return df
    spark = df.sparkSession
    limit = broadcast_limit(spark)
    large = [i for i, x in enumerate(lookups) if x.table.width > limit]
    found: dict[int, list[str]] = {i: [] for i in large}
    if large and heavy and not df.isStreaming:
        found = dict(zip(large, heavy_levels(df, [lookups[i].source for i in large])))
    tag = os.urandom(4).hex()
    columns = {f"__key{i}_{tag}": x.source.cast("string") for i, x in enumerate(lookups)}
    if large:
        columns[f"__salt_{tag}"] = _salt(df)
    names = df.columns
    out = df.withColumns(columns)
    answers: dict[str, Column] = {}
    for i, x in enumerate(lookups):
        key, at = F.col(f"__key{i}_{tag}"), f"_{i}_{tag}"
        rows = x.table.table.select(
            F.col("level").alias(f"__level{at}"), F.col("ord").alias(f"__ord{at}"), F.col("value").alias(f"__value{at}"), F.lit(0).alias(f"__zero{at}")
        )
        few: dict[str, tuple] = {}
        if i in found:
            if found[i]:
                known = x.table.table.where(F.col("level").isin(found[i])).collect()
                few = {r["level"]: (r["ord"], r["value"]) for r in known}
            apart = key.isNull() | (key.isin(found[i]) if found[i] else F.lit(False))
            out = out.join(
                rows,
                (key == F.col(f"__level{at}")) & (F.when(apart, F.col(f"__salt_{tag}")).otherwise(0) == F.col(f"__zero{at}")),
                "left",
            )
        else:
            out = out.join(F.broadcast(rows), key == F.col(f"__level{at}"), "left")
        ord_, value = F.col(f"__ord{at}"), F.col(f"__value{at}")
        if few:
            ord_ = lookup_level(key, {lv: F.lit(r[0]) for lv, r in few.items()}, ord_)
            value = lookup_level(key, {lv: F.lit(r[1]) for lv, r in few.items()}, value)
        edits = {lv: F.lit(v) for lv, v in x.table.edits}
        value = F.coalesce(value, F.lit(x.table.fallback))
        both = {"value": lookup_level(key, edits, value) if edits else value, "ord": F.coalesce(ord_, F.lit(x.table.last)).cast("int")}
        answers.update({name: both[what] for name, what in x.out.items()})
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in names if c not in answers]
    return out.select(*kept, *[c.alias(name) for name, c in answers.items()])


def numbered(levels: DataFrame, by: str = "level") -> DataFrame:
    """``levels`` with ``ord``, its place in the order of ``by``, from 0; no task sees all rows."""
    spread = levels.repartitionByRange(by).sortWithinPartitions(by).withColumn("__row", F.monotonically_increasing_id())
    table = ScratchTable(spread, "numbered").df
    task = F.shiftright("__row", 33)
    sizes = table.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r["task"], before))
        before += r["n"]
    starts = local_table(levels.sparkSession, offsets, "__task bigint, __start bigint")
    placed = table.join(starts, task == F.col("__task"))
    return placed.withColumn("ord", F.col("__row").bitwiseAND((1 << 33) - 1) + F.col("__start")).drop("__row", "__task", "__start")


def small_table(spark: SparkSession, values: Mapping[str, float], fallback: float) -> LevelTable:
    """A table of levels from the driver, for tests and hand-made tariffs."""
    rows = [(lv, i, float(v)) for i, (lv, v) in enumerate(values.items())]
    return LevelTable.write(local_table(spark, rows, LEVEL_SCHEMA), fallback)
