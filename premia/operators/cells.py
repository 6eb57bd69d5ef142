"""Compress training rows to cells: one row per combination of bins.

For fixed bins a GLM likelihood depends on a cell only through its total weight and
weighted target, so the fit runs on cells and gives what it would give on rows.  With
many predictors there are about as many cells as rows; nothing below assumes fewer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators import kernels
from premia.session import ScratchTable, rows_at_once

# A task should have this many cells to be worth starting, and no more than fit in memory.
MIN_CELLS_PER_TASK = 4_096
MAX_CELLS_PER_TASK = 4_000_000
# Up to so many possible cells, rows are aggregated without looking first.
FEW_CELLS = 1_000_000
# Cells in a packed row, packed rows that travel at once, and bytes of them read at once.
PACKED_ROWS = 10_000
PACKED_AT_ONCE = 8
PACKED_GROUP = 16 << 20
# Beyond this share of cells to rows, a shuffle costs more than the passes save.
WORTH_SHUFFLING = 0.7


def deviance_constant(y: Column, family: str) -> Column:
    """The part of a row's deviance that the mean does not enter."""
    zero = F.lit(0.0)
    if family == "poisson":
        return F.when(y > 0, y * F.log(y)).otherwise(zero)
    if family == "gamma":
        return F.log(y)
    if family == "gaussian":
        return y * y
    return F.when(y > 0, y * F.log(y)).otherwise(zero) + F.when(
        y < 1, (1.0 - y) * F.log(1.0 - y)
    ).otherwise(zero)


def _rows(df, bins, raws, y, w, family, fold):
    """The rows with a column per key, ``y`` and ``w``; the names of the keys; the constant part of the deviance."""
    keys = [(fold if fold is not None else F.lit(0)).cast("int").alias("fold")]
    keys += [c.cast("int").alias(f"b{i}") for i, c in enumerate(bins.values())]
    keys += [c.cast("double").alias(f"r{i}") for i, c in enumerate(raws.values())]
    rows = df.select(*keys, y.cast("double").alias("y"), w.cast("double").alias("w"))
    return rows, rows.columns[: len(keys)], F.col("w") * deviance_constant(F.col("y"), family)


def _as_they_are(rows, names, constant) -> DataFrame:
    return rows.select(
        *names, F.col("w").alias("sw"), (F.col("w") * F.col("y")).alias("swy"), constant.alias("swh"),
        F.lit(1).cast("bigint").alias("n"),
    )


def _summed(rows, names, constant) -> DataFrame:
    return rows.groupBy(*names).agg(
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("y")).alias("swy"),
        F.sum(constant).alias("swh"),
        F.count(F.lit(1)).alias("n"),
    )


def aggregate_cells(
    df: DataFrame,
    bins: Mapping[str, Column],
    raws: Mapping[str, Column],
    y: Column,
    w: Column,
    family: str,
    fold: Column | None = None,
    sizes: Sequence[int] | None = None,
    once: bool = False,
) -> DataFrame:
    """``(fold, b0.., r0.., sw, swy, swh, n)``: the sums each cell contributes.

    ``sizes`` are the numbers of bins.  Where they allow more cells than can be taken
    for few, the distinct ones are estimated in a pass without shuffle, and rows that
    would hardly compress stay as they are instead of being shuffled for nothing.  With ``once``,
    for a single pass, they stay without that look.
    """
    rows, names, constant = _rows(df, bins, raws, y, w, family, fold)
    if sizes is not None and (many_cells(sizes, raws) if once else not _compresses(rows, names, math.prod(sizes), bool(raws))):
        return _as_they_are(rows, names, constant)
    return _summed(rows, names, constant)


def many_cells(sizes: Sequence[int], raws) -> bool:
    return bool(raws) or math.prod(sizes) > FEW_CELLS


def _compresses(rows: DataFrame, names: Sequence[str], possible: int, raws: bool) -> bool:
    if not raws and possible <= FEW_CELLS:
        return True
    return compresses(rows, names)


def compresses(rows: DataFrame, names: Sequence[str]) -> bool:
    """Whether summing rows by ``names`` saves enough of them, by an estimate in a pass without shuffle."""
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.xxhash64(*names)).alias("cells"),
    ).first()
    return seen["cells"] <= WORTH_SHUFFLING * seen["n"]


def _packed(cells: DataFrame, groups: kernels.Groups, n_folds: int) -> DataFrame:
    """Cells as a few large rows, see ``kernels.pack_task``."""
    code = []
    for members in groups.members:
        total = F.lit(0).cast("bigint")
        for v in members:
            total = total * F.lit(groups.layout.sizes[v]) + F.col(f"b{v}")
        code.append(total)
    words = []
    for k, members in enumerate(groups.words):
        word = code[members[0]]
        for i, g in enumerate(members[1:], 1):
            word = word.bitwiseOR(F.shiftleft(code[g], 16 * i))
        words.append(word.alias(f"p{k}"))
    raws = [f"r{i}" for i in range(groups.layout.n_raw)]
    return cells.select(*words, *raws, "fold", "sw", "swy", "swh").mapInArrow(kernels.pack_task(groups, n_folds), kernels.PACKED_SCHEMA)


def task_count(n_cells: int, cores: int) -> int:
    """Tasks of one pass: a wave for all cores where that pays, more only for memory.

    Every task sends back sums of one size, whatever its number of cells, so more tasks
    than cores would only add traffic.
    """
    useful = math.ceil(n_cells / MIN_CELLS_PER_TASK)
    needed = math.ceil(n_cells / MAX_CELLS_PER_TASK)
    if needed > cores:
        return math.ceil(needed / cores) * cores
    return max(1, min(useful, cores))


@dataclass
class CellTable:
    """Cells written to the shared folder and cached for the passes of one fit."""

    scratch: ScratchTable | None
    df: DataFrame
    n_cells: int | None
    #: How the predictors of packed cells are grouped; None where a row is a cell.
    groups: kernels.Groups | None = None

    @classmethod
    def unwritten(cls, cells: DataFrame) -> CellTable:
        """For one pass only, which need neither be written nor counted before."""
        return cls(None, cells, None)

    @classmethod
    def pack(
        cls, df: DataFrame, bins: Mapping[str, Column], raws: Mapping[str, Column], y: Column, w: Column, family: str,
        layout: kernels.Layout, fold: Column | None = None, folds: int = 1,
    ) -> CellTable:
        """Cells of passes that ask for no matrix of all bins, some thousand to a row of arrays.

        Rows are packed as they are; where the least hashes of their keys show that they compress, they are summed first.
        """
        rows, names, constant = _rows(df, bins, raws, y, w, family, fold)
        groups = kernels.Groups(layout)
        sizes = [*layout.sizes, folds]
        scratch = None
        if many_cells(sizes, raws):
            scratch = cls._write_packed(_as_they_are(rows, names, constant), groups, folds)
            n, cells = cls._count_packed(scratch.df)
        if scratch is None or cells <= WORTH_SHUFFLING * n:
            if scratch is not None:
                scratch.drop()
            scratch = cls._write_packed(_summed(rows, names, constant), groups, folds)
            n, _ = cls._count_packed(scratch.df)
        return cls._spread(scratch, scratch.df.where("packed IS NOT NULL").select("packed"), n, groups)

    @staticmethod
    def _write_packed(cells: DataFrame, groups: kernels.Groups, folds: int) -> ScratchTable:
        with rows_at_once(cells.sparkSession, PACKED_ROWS):
            # Spark reads a row group at once, so these are small.
            return ScratchTable(_packed(cells, groups, folds), "cells", **{"parquet.block.size": PACKED_GROUP, "parquet.block.size.row.check.min": 1})

    @staticmethod
    def _count_packed(packed: DataFrame) -> tuple[int, float]:
        n = packed.agg(F.sum("n")).first()[0] or 0
        found = packed.where("hashes IS NOT NULL").select("hashes").toArrow()["hashes"]
        hashes = np.zeros(0, np.uint64)
        for value in found:
            hashes = kernels.least(np.concatenate([hashes, np.frombuffer(value.as_buffer(), np.uint64)]))
        return n, kernels.distinct_hashes(hashes)

    @classmethod
    def build(cls, cells: DataFrame) -> CellTable:
        scratch = ScratchTable(cells, "cells")
        return cls._spread(scratch, scratch.df, scratch.df.count())

    @classmethod
    def _spread(cls, scratch: ScratchTable, df: DataFrame, n: int, groups: kernels.Groups | None = None) -> CellTable:
        spark = df.sparkSession
        cores = spark.sparkContext.defaultParallelism
        wanted = task_count(n, cores)
        have = df.rdd.getNumPartitions()
        if wanted < have:
            df = df.coalesce(wanted)
        elif wanted > have:
            df = df.repartition(wanted)
        return cls(scratch, df.persist(StorageLevel.MEMORY_AND_DISK), n, groups)

    def close(self) -> None:
        if self.scratch is None:
            return
        self.df.unpersist()
        self.scratch.drop()
