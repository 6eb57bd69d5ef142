"""Exact order statistics of many columns at once, without sorting a column.

A mergeable sketch proposes splitters around each wanted rank; one exact count per
interval between splitters then tells which interval a rank falls in.  A rank that
lands on a splitter is done; otherwise the rows strictly inside the interval become the
input of the next round.  The sketch only decides how far the data shrinks per round,
never the result.  Once an interval is small enough its values are counted and ranked.
No row is shuffled except the few in such a last interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.names import column
from premia.operators import kernels
from premia.session import ScratchTable, local_table

# Executors get the kernels with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(kernels)

# An interval with at most this many rows is ranked by one window task.
RANK_LIMIT = 200_000
SKETCH_K = 2048
SKETCH_MARGIN = 0.003
# A column with at most this many values can be counted value by value.
FEW_VALUES = 4_096
# Steps of the grid that splits an interval found earlier; one grid serves all of them.
INNER_STEPS = 512


@dataclass
class Interval:
    """Values of one column strictly between two bounds, some ranks of which are wanted.

    ``below`` values of the column come before the interval and ``n`` lie in it.  An
    open bound is None, since infinities are values too.
    """

    name: str
    lower: float | None
    upper: float | None
    below: int
    n: int
    ranks: list[int]

    @property
    def whole(self) -> bool:
        return self.lower is None and self.upper is None

    def holds(self, lower: float | None, upper: float | None) -> bool:
        """Whether the open range between two cuts lies in this interval."""
        from_here = self.lower is None or (lower is not None and lower >= self.lower)
        to_here = self.upper is None or (upper is not None and upper <= self.upper)
        return from_here and to_here

    def contains(self, x: float) -> bool:
        above = self.lower is None or x > self.lower
        return above and (self.upper is None or x < self.upper)


def nearest_rank(q: float, n: int) -> int:
    """0-based rank of the nearest observation."""
    return min(max(math.floor(q * (n - 1) + 0.5), 0), n - 1)


def _values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns as doubles called v0, v1, ..; NaN counts as missing."""
    doubles = [column(c).cast("double") for c in names]
    return df.select(
        *[F.when(~F.isnan(x), x).alias(f"v{i}") for i, x in enumerate(doubles)]
    )


def _members(values: DataFrame, names: Sequence[str], intervals: Sequence[Interval]) -> DataFrame:
    """``(part, x)``: the values inside each interval, by position in the list."""
    if all(i.whole for i in intervals):
        pairs = [
            y for k, i in enumerate(intervals)
            for y in (F.lit(k), F.col(f"v{names.index(i.name)}"))
        ]
        long = values.select(F.stack(F.lit(len(intervals)), *pairs).alias("part", "x"))
        return long.where(F.col("x").isNotNull())
    places = [names.index(i.name) for i in intervals]
    bounds = [(i.lower, i.upper) for i in intervals]

    def pick(batches):
        for batch in batches:
            cols = {}
            for k, (at, (lo, hi)) in enumerate(zip(places, bounds)):
                if at not in cols:
                    cols[at] = batch.column(at).to_numpy(zero_copy_only=False)
                x = cols[at]
                keep = ~np.isnan(x)
                if lo is not None:
                    keep &= x > lo
                if hi is not None:
                    keep &= x < hi
                x = x[keep]
                if len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), pa.array(x)], ["part", "x"]
                    )

    return values.mapInArrow(pick, "part int, x double")


def _rank(members: DataFrame, intervals: Sequence[Interval]) -> list[dict[int, float]]:
    """Wanted ranks of intervals known to hold at most RANK_LIMIT values each."""
    spark = members.sparkSession
    upto = Window.partitionBy("part").orderBy("x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = (
        members.groupBy("part", "x")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
    )
    wanted = local_table(
        spark,
        [(k, int(r - i.below)) for k, i in enumerate(intervals) for r in i.ranks],
        "wanted_part int, r bigint",
    )
    # At most a few dozen ranks per interval.
    hit = running.join(
        F.broadcast(wanted),
        (F.col("part") == F.col("wanted_part"))
        & (F.col("r") < F.col("upto"))
        & (F.col("r") >= F.col("upto") - F.col("n")),
    )
    out: list[dict[int, float]] = [{} for _ in intervals]
    for row in hit.select("part", "r", "x").collect():
        out[row["part"]][row["r"] + intervals[row["part"]].below] = row["x"]
    return out


def _merge_groups(df: DataFrame) -> int:
    """Groups in which sketches are merged before the last merge."""
    return max(1, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _grid(interval: Interval) -> list[float]:
    """Where to split: a little to either side of each wanted rank."""
    at = [(r - interval.below) / max(interval.n - 1, 1) for r in interval.ranks]
    steps = (-SKETCH_MARGIN, 0.0, SKETCH_MARGIN)
    return sorted({min(max(q + d, 0.0), 1.0) for q in at for d in steps})


def _propose(
    values: DataFrame, names: Sequence[str], intervals: Sequence[Interval]
) -> list[list[float]]:
    """Splitters per interval, from sketches merged in two steps."""
    group = (F.spark_partition_id() % _merge_groups(values)).alias("g")

    def grid(sketch, interval):
        points = F.array(*[F.lit(p) for p in _grid(interval)])
        return F.kll_sketch_get_quantile_double(sketch, points)

    if all(i.whole for i in intervals):
        cols = [f"v{names.index(i.name)}" for i in intervals]
        sketches = values.groupBy(group).agg(
            *[F.kll_sketch_agg_double(F.col(c), F.lit(SKETCH_K)).alias(c) for c in cols]
        )
        merged = sketches.agg(
            *[F.kll_merge_agg_double(F.col(c), F.lit(SKETCH_K)).alias(c) for c in cols]
        )
        row = merged.select(
            *[grid(F.col(c), i).alias(c) for c, i in zip(cols, intervals)]
        ).first()
        return [sorted(set(row[c])) for c in cols]
    sketches = (
        _members(values, names, intervals)
        .groupBy("part", group)
        .agg(F.kll_sketch_agg_double(F.col("x"), F.lit(SKETCH_K)).alias("s"))
        .groupBy("part")
        .agg(F.kll_merge_agg_double(F.col("s"), F.lit(SKETCH_K)).alias("s"))
    )
    points = F.array(*[F.lit(j / INNER_STEPS) for j in range(INNER_STEPS + 1)])
    rows = sketches.select("part", F.kll_sketch_get_quantile_double(F.col("s"), points)).collect()
    out: list[list[float]] = [[] for _ in intervals]
    for part, quantiles in rows:
        i = intervals[part]
        near = set()
        for r in i.ranks:
            at = int((r - i.below) / max(i.n - 1, 1) * INNER_STEPS)
            near.update(quantiles[j] for j in range(max(at - 1, 0), min(at + 3, INNER_STEPS + 1)))
        out[part] = sorted(near)
    return out


def _count_cells(
    values: DataFrame, names: Sequence[str], cuts: Mapping[str, Sequence[float]]
) -> dict[str, dict[int, int]]:
    """Exact counts around sorted cuts: code 2i is strictly between cuts i-1 and i, and
    2i-1 is equal to cut i-1.

    Each task counts its rows in arrays and sends one row per cell.
    """
    places = [(names.index(c), np.asarray(x, dtype=float)) for c, x in cuts.items()]

    def count(batches):
        totals = {at: np.zeros(2 * len(x) + 1, np.int64) for at, x in places}
        for batch in batches:
            for at, edges in places:
                x = batch.column(at).drop_null().to_numpy(zero_copy_only=False)
                code = np.searchsorted(edges, x, "left") + np.searchsorted(edges, x, "right")
                totals[at] += np.bincount(code, minlength=len(totals[at]))
        for at, n in totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), at, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(n[used]),
                ],
                ["v", "code", "n"],
            )

    cells = values.mapInArrow(count, "v int, code int, n bigint")
    out: dict[str, dict[int, int]] = {c: {} for c in cuts}
    for row in cells.groupBy("v", "code").agg(F.sum("n").alias("n")).collect():
        out[names[row["v"]]][row["code"]] = row["n"]
    return out


def _split(
    intervals: Sequence[Interval],
    splitters: Sequence[Sequence[float]],
    counts: Callable[[Mapping[str, Sequence[float]]], dict[str, dict[int, int]]],
    found: dict[str, dict[int, float]],
) -> list[Interval]:
    """Count around the splitters; note ranks that land on one, return the rest."""
    cuts: dict[str, set[float]] = {}
    for i, s in zip(intervals, splitters):
        bounds = {b for b in (i.lower, i.upper) if b is not None}
        cuts.setdefault(i.name, set()).update(s, bounds)
    ordered = {c: sorted(x) for c, x in cuts.items()}
    cells = counts(ordered)
    narrower = []
    for i in intervals:
        edges, below = ordered[i.name], i.below
        for code, n in sorted(cells[i.name].items()):
            at = code // 2
            here = [r for r in i.ranks if below <= r < below + n]
            if code % 2:
                if not i.contains(edges[at]):
                    continue
                found[i.name].update({r: edges[at] for r in here})
            else:
                lower = edges[at - 1] if at else None
                upper = edges[at] if at < len(edges) else None
                if not i.holds(lower, upper):
                    continue
                if here:
                    narrower.append(Interval(i.name, lower, upper, below, n, here))
            below += n
    return narrower


def _value_counts(
    values: DataFrame, names: Sequence[str], ranks_of: Callable[[str, int], Sequence[int]]
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Numbers of values of all columns, and the wanted ranks of those with at most FEW_VALUES different ones."""
    cells = values.mapInArrow(kernels.value_counts_task(len(names), FEW_VALUES), kernels.COUNT_SCHEMA)
    table = ScratchTable(cells.groupBy("v", "x", "many").agg(F.sum("n").alias("n")), "value-counts")
    try:
        summary = table.df.groupBy("v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("many").alias("many")).collect()
        few = [row["v"] for row in summary if not row["many"] and row["rows"] <= FEW_VALUES]
        rows = table.df.where(F.col("v").isin(few)).select("v", "x", "n").toArrow()
    finally:
        table.drop()
    counts = dict.fromkeys(names, 0) | {names[row["v"]]: row["n"] for row in summary}
    of, x, n = (rows[c].to_numpy() for c in ("v", "x", "n"))
    found: dict[str, dict[int, float]] = {}
    for v in few:
        own = np.flatnonzero(of == v)
        own = own[np.argsort(x[own])]
        upto = np.cumsum(n[own])
        found[names[v]] = {r: float(x[own[np.searchsorted(upto, r, "right")]]) for r in ranks_of(names[v], counts[names[v]])}
    return counts, found


def order_statistics(
    df: DataFrame,
    names: Sequence[str],
    ranks_of: Callable[[str, int], Sequence[int]],
    rank_limit: int = RANK_LIMIT,
    counts: Mapping[str, int] | None = None,
    few: bool = False,
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Counts of non-missing values, and ``{column: {0-based rank: value}}``.

    ``counts`` saves a pass where the numbers of values, NaN aside, are known.  With ``few`` the pass that
    counts them counts each value too, which settles all ranks of a column of few different ones.
    """
    names = list(names)
    if not names:
        return {}, {}
    values = _values(df, names)
    known: dict[str, dict[int, float]] = {}
    if few:
        counts, known = _value_counts(values, names, ranks_of)
    elif counts is None:
        row = values.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
        counts = {c: row[f"v{i}"] for i, c in enumerate(names)}
    else:
        counts = {c: counts[c] for c in names}
    found: dict[str, dict[int, float]] = {c: known.get(c, {}) for c in names}
    open_ = [
        Interval(c, None, None, 0, n, sorted(set(ranks_of(c, n))))
        for c, n in counts.items()
        if n and c not in known
    ]
    small: list[Interval] = []
    while open_:
        small += [i for i in open_ if i.n <= rank_limit]
        large = [i for i in open_ if i.n > rank_limit]
        open_ = []
        if large:
            splitters = _propose(values, names, large)
            open_ = _split(
                large, splitters, lambda cuts: _count_cells(values, names, cuts), found
            )
    # Whole columns and parts of columns are read in different ways.
    for group in ([i for i in small if i.whole], [i for i in small if not i.whole]):
        if group:
            ranked = _rank(_members(values, names, group), group)
            for i, got in zip(group, ranked):
                found[i.name].update(got)
    return counts, found


def nearest_quantiles(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], **kw
) -> dict[str, list[float]]:
    """Nearest-rank quantiles of each column; an empty list where all is missing."""
    counts, found = order_statistics(
        df, names, lambda _c, n: [nearest_rank(q, n) for q in probs], **kw
    )
    return {
        c: [found[c][nearest_rank(q, counts[c])] for q in probs] if counts[c] else []
        for c in names
    }


def linear_quantiles(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], **kw
) -> dict[str, list[float]]:
    """Quantiles interpolated between the two neighbouring observations."""

    def both(_c: str, n: int) -> list[int]:
        at = [q * (n - 1) for q in probs]
        return [r for a in at for r in (math.floor(a), math.ceil(a))]

    counts, found = order_statistics(df, names, both, **kw)
    out = {}
    for c in names:
        out[c] = []
        for q in probs if counts[c] else ():
            a = q * (counts[c] - 1)
            lo, hi = found[c][math.floor(a)], found[c][math.ceil(a)]
            out[c].append(lo + (hi - lo) * (a - math.floor(a)))
    return out


def approximate_quantiles(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float]]:
    """Sketch quantiles in one pass, for when a scan more matters than exactness."""
    names = list(names)
    if not names:
        return {}
    row = _values(df, names).agg(
        *[F.percentile_approx(F.col(f"v{i}"), list(probs), accuracy).alias(f"q{i}")
          for i in range(len(names))]
    ).first()
    return {c: list(row[f"q{i}"] or []) for i, c in enumerate(names)}
