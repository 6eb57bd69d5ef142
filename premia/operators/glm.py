"""Elastic-net GLMs fitted by Spark passes over cells.

Objective, with coefficients on standardised features and a free intercept::

    deviance(y, mean) / (2 * sum w) + alpha * (l1_ratio * |b|_1 + (1 - l1_ratio)/2 * |b|^2)

Every problem of a cross-validated grid -- held-out fold, l1 ratio, alpha -- is a set of
linear predictors in one pass, so the number of passes is that of a single fit.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.binning import OTHER, lookup_level, lookup_range
from premia.functions.loss import family_name, inverse_link
from premia.functions.names import column
from premia.functions.split import TRAIN_FLAG
from premia.operators import kernels
from premia.operators.blueprint import Blueprint, VariablePlan, as_blueprint, level_counts, level_plans
from premia.operators.cells import PACKED_AT_ONCE, CellTable, aggregate_cells, many_cells
from premia.operators.levels import CASE_LEVELS, LEVEL_SCHEMA, LevelTable, Lookup, attach
from premia.operators.prepare import fill_nulls, mean_aggregates, mean_values, with_bins
from premia.operators.solver import kkt_gap, solve_quadratics
from premia.operators.validate import check_columns, validate_fit_input
from premia.operators.wide import RangeDesign, WideFitter
from premia.session import local_table, rows_at_once

# Executors get the kernels with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(kernels)

# The defaults of a fit.
DEFAULT_FOLDS = 5
DEFAULT_L1_RATIOS = (0.0, 0.5, 1.0)
DEFAULT_MAX_ITER = 150
DEFAULT_N_ALPHAS = 100
DEFAULT_MIN_ALPHA_RATIO = 1e-6
# Largest alpha of the grid for a pure ridge penalty, which no alpha shrinks to zero.
RIDGE_ALPHA_MAX = 10.0
GRADIENT_TOL = 1e-9
# Doubles in the result of one task of one pass.
PASS_BUDGET = 4_000_000
# Doubles in the Gram matrices the driver holds at once.
SOLVER_BUDGET = 8_000_000
# Partial sums are added in a tree with this many inputs per node.
FAN_IN = 32
# Means of one aggregate: with many more its generated code gets too long to be compiled.
MEANS_AT_ONCE = 10
# Beyond so many features, or doubles in one packed Gram matrix, none is built over all of them.
DENSE_FEATURES = 1_500
DENSE_PACKED = 250_000
# Of the draw that deals rows to folds; cells are written once, so all passes agree on it.
FOLD_SEED = 20


# --------------------------------------------------------------------------- features


@dataclass(frozen=True)
class Feature:
    variable: str
    name: str


class Design:
    """Features of a fit and how they follow from one-hot bins."""

    def __init__(
        self,
        blueprint: Blueprint,
        binned: Sequence[str],
        raws: Sequence[str],
        drop_first: bool = False,
    ):
        self.binned = list(binned)
        self.raws = list(raws)
        self.layout = kernels.Layout([blueprint[v].size for v in binned], len(raws))
        features, columns = [], []
        for v, at in zip(self.binned, self.layout.offsets):
            plan = blueprint[v]
            if plan.kind == "numeric":
                # A value is below break j exactly if its bin id is at most j.
                for j, b in enumerate(plan.breaks):
                    features.append(Feature(v, f"{v}{b}"))
                    columns.append((at, at + j + 1))
            else:
                for j, lv in enumerate((*plan.levels, OTHER)):
                    if drop_first and j == 0:
                        continue
                    features.append(Feature(v, f"{v}_lumped[{lv}]"))
                    columns.append((at + j, at + j + 1))
        for j, v in enumerate(self.raws):
            features.append(Feature(v, v))
            columns.append((self.layout.raw_at + j, self.layout.raw_at + j + 1))
        self.features = features
        self.matrix = np.zeros((self.layout.dim, 1 + len(features)))
        self.matrix[0, 0] = 1.0
        for j, (lo, hi) in enumerate(columns):
            self.matrix[lo:hi, j + 1] = 1.0

    def score(self, onehot: np.ndarray) -> np.ndarray:
        return onehot @ self.matrix

    def gram(self, packed: np.ndarray) -> np.ndarray:
        return self.matrix.T @ self.layout.unpack(packed) @ self.matrix

    def onehot_coefs(self, intercept: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.column_stack([intercept, beta]) @ self.matrix.T


# ------------------------------------------------------------------------------ passes


def _tree_sum(partials: DataFrame, parts: int) -> np.ndarray:
    """Add up one payload per partition, on executors until few are left."""
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        partials = partials.repartition(parts, F.col("part") % parts).mapInArrow(
            kernels.add_task(), kernels.PARTIAL_SCHEMA
        )
    total = None
    # Arrow brings the few payloads over without converting them row by row.
    for value in partials.select("payload").toArrow()["payload"]:
        x = np.frombuffer(value.as_buffer())
        total = x.copy() if total is None else total + x
    return total


class CellPasses:
    """The two questions a fit asks of its cells."""

    def __init__(self, cells: CellTable, design: Design, family: str, n_folds: int):
        self.cells, self.design = cells, design
        self.family, self.n_folds = family, n_folds
        self.parts = cells.df.rdd.getNumPartitions()
        self.count = 0

    def _sum(self, task) -> np.ndarray:
        """The payloads of a task over all cells, added up."""
        spark = self.cells.df.sparkSession
        with rows_at_once(spark, PACKED_AT_ONCE) if self.cells.groups else nullcontext():
            total = _tree_sum(self.cells.df.mapInArrow(task, kernels.PARTIAL_SCHEMA), self.parts)
        self.count += 1
        return total

    def moments(self) -> dict[str, np.ndarray]:
        layout, d = self.design.layout, self.design.layout.dim
        total = self._sum(kernels.moments_task(layout, self.n_folds)).reshape(self.n_folds, -1)
        return {
            "xy": self.design.score(total[:, :d]),
            "w": total[:, d],
            "h": total[:, d + 1],
            "gram": self.design.gram(total[:, d + 2 :]),
        }

    def evaluate(self, intercept, beta, held_out, with_gram):
        """Score, Gram (or None), train deviance, held-out deviance and weight."""
        layout, d = self.design.layout, self.design.layout.dim
        coefs = self.design.onehot_coefs(intercept, beta)
        groups = self.cells.groups
        limit = max(1, PASS_BUDGET // (d + 3 + (layout.packed if with_gram else 0) + (sum(groups.sizes) if groups else 0)))
        if len(coefs) > limit:
            # More problems than the result of one task may hold: several passes.
            cuts = range(0, len(coefs), limit)
            parts = [
                self.evaluate(intercept[i : i + limit], beta[i : i + limit], held_out[i : i + limit], with_gram) for i in cuts
            ]
            return tuple(None if x[0] is None else np.concatenate(x) for x in zip(*parts))
        if groups:
            task = kernels.pass_packed_task(groups, self.family, coefs, list(held_out), self.n_folds)
        else:
            task = kernels.pass_task(layout, self.family, coefs, list(held_out), with_gram)
        total = self._sum(task).reshape(len(coefs), -1)
        gram = self.design.gram(total[:, d + 3 :]) if with_gram else None
        return self.design.score(total[:, :d]), gram, *total[:, d : d + 3].T


    def light_moments(self) -> dict[str, np.ndarray]:
        """What standardising and the null model need, without any matrix."""
        layout, d = self.design.layout, self.design.layout.dim
        groups = self.cells.groups
        task = kernels.light_moments_packed_task(groups, self.n_folds) if groups else kernels.light_moments_task(layout, self.n_folds)
        total = self._sum(task).reshape(self.n_folds, -1)
        wx = self.design.score(total[:, d : 2 * d])
        # The square of a sum of one-hot entries is the sum itself.
        square = wx[:, 1:].copy()
        if layout.n_raw:
            square[:, -layout.n_raw :] = total[:, 2 * d : 2 * d + layout.n_raw]
        return {"xy": self.design.score(total[:, :d]), "wx": wx, "sq": square, "w": total[:, -2], "h": total[:, -1]}

    def active_grams(self, intercept, beta, held_out, active) -> list[np.ndarray]:
        """Per problem the Gram matrix of the intercept and its active features, as many problems a pass as fit."""
        coefs = self.design.onehot_coefs(intercept, beta)
        columns = [self.design.columns(a) for a in active]
        out, at = [], 0
        while at < len(columns):
            size, end = 0, at
            while end < len(columns) and (end == at or size + (len(columns[end]) + 1) ** 2 <= PASS_BUDGET):
                size += (len(columns[end]) + 1) ** 2
                end += 1
            here = slice(at, end)
            total = self._sum(
                kernels.active_packed_task(self.cells.groups, self.family, coefs[here], held_out[here], columns[here], self.n_folds)
            )
            for c in columns[at:end]:
                n = len(c) + 1
                out.append(total[: n * n].reshape(n, n))
                total = total[n * n :]
            at = end
        return out


@dataclass
class Problem:
    """One penalised fit: the cells outside ``held_out``, at one penalty."""

    held_out: int
    l1_ratio: float
    alpha: float
    intercept: float = 0.0
    beta: np.ndarray | None = None
    train_deviance: float = math.nan
    held_out_deviance: float = math.nan
    gap: float = math.inf
    converged: bool = False


def alpha_grid(gradient: np.ndarray, l1_ratio: float, n: int, ratio: float) -> np.ndarray:
    """Penalties from the one that zeroes all features down, given the gradient at the null model."""
    top = RIDGE_ALPHA_MAX if l1_ratio == 0 else float(np.abs(gradient).max(initial=0.0) / l1_ratio)
    return np.geomspace(top, top * ratio, n) if top > 0 else np.array([1.0])


class Fitter:
    """Solves batches of problems that share cells, family and features."""

    def __init__(
        self,
        passes: CellPasses,
        fit_intercept: bool = True,
        scale_predictors: bool = True,
        max_iter: int = DEFAULT_MAX_ITER,
        tol: float = GRADIENT_TOL,
    ):
        self.passes = passes
        self.family = passes.family
        self.fit_intercept = fit_intercept
        self.scale = scale_predictors
        self.max_iter = max_iter
        self.tol = tol
        self.folds = passes.moments()
        self.p = len(passes.design.features)
        self._by_fold: dict[int, dict] = {}

    def train(self, held_out: int) -> dict:
        """Moments of the training cells, the null model and the feature scales."""
        if held_out not in self._by_fold:
            keep = np.arange(self.passes.n_folds) != held_out
            m = {k: v[keep].sum(axis=0) for k, v in self.folds.items()}
            mean = m["gram"][0, 1:] / m["w"]
            var = np.diag(m["gram"])[1:] / m["w"] - mean**2
            live = var > 1e-12 * np.maximum(1.0, mean**2)
            sd = np.sqrt(np.where(live, var, 1.0)) if self.scale else np.ones(self.p)
            if not self.fit_intercept:
                live = np.diag(m["gram"])[1:] > 0
            y_mean = m["xy"][0] / m["w"]
            m["null"] = self._link(y_mean) if self.fit_intercept else 0.0
            m["sd"], m["live"] = sd, live
            self._by_fold[held_out] = m
        return self._by_fold[held_out]

    def _link(self, mean: float) -> float:
        if self.family == "gaussian":
            return mean
        if self.family == "binomial":
            mean = min(max(mean, 1e-12), 1 - 1e-12)
            return math.log(mean / (1 - mean))
        return math.log(max(mean, 1e-300))

    def _at_null(self, held_out: int):
        """Score, Gram and deviance at the null model, from the moments alone.

        The Gram matrix uses the expected curvature, which needs no pass; later ones use
        the curvature of the likelihood itself.
        """
        m = self.train(held_out)
        mu = kernels.mean_of(np.array([m["null"]]), self.family)
        w, wy = np.array([m["w"]]), np.array([m["xy"][0]])
        score = kernels.residual(m["gram"][0], m["xy"], mu[0], self.family)
        unit = kernels.curvature(np.ones(1), mu, mu, self.family)
        dev = kernels.total_deviance(w, wy, m["h"], mu, self.family)
        return score, m["gram"] * unit, dev

    def null_gradient(self, held_out: int = -1) -> np.ndarray:
        m = self.train(held_out)
        score, _, _ = self._at_null(held_out)
        return np.where(m["live"], score[1:] / m["sd"] / m["w"], 0.0)

    def _gaussian(self, problems, intercept, beta):
        """What a pass would return; for squared error the moments determine it."""
        coef = np.column_stack([intercept, beta])
        score, dev, out_dev, out_w = [], [], [], []
        for pr, b in zip(problems, coef):
            m = self.train(pr.held_out)
            score.append(m["xy"] - m["gram"] @ b)
            dev.append(m["h"] - 2 * b @ m["xy"] + b @ m["gram"] @ b)
            if pr.held_out < 0:
                out_dev.append(0.0)
                out_w.append(0.0)
            else:
                f = {k: v[pr.held_out] for k, v in self.folds.items()}
                out_dev.append(f["h"] - 2 * b @ f["xy"] + b @ f["gram"] @ b)
                out_w.append(f["w"])
        return np.array(score), None, *map(np.array, (dev, out_dev, out_w))

    def _evaluate(self, problems, intercept, beta, with_gram):
        if self.family == "gaussian":
            return self._gaussian(problems, intercept, beta)
        held = [pr.held_out for pr in problems]
        return self.passes.evaluate(intercept, beta, held, with_gram)

    @property
    def constant_weights(self) -> bool:
        return self.family == "gaussian"

    def solve(self, problems: Sequence[Problem]) -> None:
        """Solve all problems in chunks whose pass results fit the budget.

        A chunk later in the order starts from the neighbouring solution before it.
        """
        layout = self.passes.design.layout
        size = layout.dim + 3 + (0 if self.constant_weights else layout.packed)
        limit = max(1, min(PASS_BUDGET // size, SOLVER_BUDGET // (self.p + 1) ** 2))
        order = sorted(problems, key=lambda pr: -pr.alpha)
        last: dict[tuple, Problem] = {}
        for i in range(0, len(order), limit):
            chunk = order[i : i + limit]
            for pr in chunk:
                before = last.get((pr.held_out, pr.l1_ratio))
                if pr.beta is None and before is not None:
                    pr.intercept, pr.beta = before.intercept, before.beta
            self._solve_chunk(chunk)
            last.update({(pr.held_out, pr.l1_ratio): pr for pr in chunk})

    def _solve_chunk(self, problems: list[Problem]) -> None:
        k, p = len(problems), self.p
        total_w = np.array([self.train(pr.held_out)["w"] for pr in problems])
        sd = np.array([self.train(pr.held_out)["sd"] for pr in problems]).reshape(k, p)
        live = np.array([self.train(pr.held_out)["live"] for pr in problems]).reshape(k, p)
        l1 = np.array([pr.alpha * pr.l1_ratio for pr in problems])
        l2 = np.array([pr.alpha * (1 - pr.l1_ratio) for pr in problems])
        base = {
            pr.held_out: max(np.abs(self.null_gradient(pr.held_out)).max(initial=0.0), 1e-12)
            for pr in problems
        }
        tol = self.tol * np.array([base[pr.held_out] for pr in problems])

        warm = [pr.beta is not None for pr in problems]
        b0 = np.array(
            [pr.intercept if wm else self.train(pr.held_out)["null"]
             for pr, wm in zip(problems, warm)]
        )
        u = np.array([pr.beta if wm else np.zeros(p) for pr, wm in zip(problems, warm)])
        u = u.reshape(k, p) * sd * live
        score = np.zeros((k, 1 + p))
        gram = np.zeros((k, 1 + p, 1 + p))
        dev, out = np.zeros(k), np.full(k, np.nan)
        for i, pr in enumerate(problems):
            score[i], gram[i], dev[i] = self._at_null(pr.held_out)
        if any(warm):
            self._refresh(problems, np.flatnonzero(warm), b0, u / sd, score, gram, dev, out)

        def penalty(idx, v):
            return l1[idx] * np.abs(v).sum(1) + 0.5 * l2[idx] * (v * v).sum(1)

        def objective(idx, d_, v):
            return d_ / (2 * total_w[idx]) + penalty(idx, v)

        def gaps(idx):
            q = np.where(live[idx], score[idx, 1:] / sd[idx] / total_w[idx, None], 0.0)
            g = kkt_gap(q, u[idx], l1[idx], l2[idx])
            if self.fit_intercept:
                g = np.maximum(g, np.abs(score[idx, 0]) / total_w[idx])
            return g

        best = objective(np.arange(k), dev, u)
        open_ = np.arange(k)
        open_ = open_[(gaps(open_) > tol[open_]) | np.isnan(out[open_])]
        step_b0, step_u = np.zeros(k), np.zeros((k, p))
        fresh = np.ones(k, dtype=bool)
        halvings = np.zeros(k, dtype=int)
        for _ in range(self.max_iter):
            if not len(open_):
                break
            new = open_[fresh[open_]]
            if len(new):
                step_b0[new], step_u[new] = self._newton(
                    new, score, gram, u, sd, live, total_w, l1, l2, tol
                )
            try_b0, try_u = b0[open_] + step_b0[open_], u[open_] + step_u[open_]
            tried = [problems[i] for i in open_]
            s, g, d_, out_d, out_w = self._evaluate(
                tried, try_b0, try_u / sd[open_], not self.constant_weights
            )
            value = objective(open_, d_, try_u)
            slack = 1e-12 * np.maximum(1.0, np.abs(best[open_]))
            good = value <= best[open_] + slack
            # After many halvings the step is below rounding: keep it and stop there.
            good |= halvings[open_] >= 30
            ok = open_[good]
            u[ok], b0[ok], dev[ok] = try_u[good], try_b0[good], d_[good]
            # A coordinate the solver set to zero must be zero, not a rounding residue.
            u[ok] = np.where(np.abs(u[ok]) < 1e-14, 0.0, u[ok])
            score[ok], best[ok] = s[good], value[good]
            if g is not None:
                gram[ok] = g[good]
            out[ok] = np.divide(
                out_d[good], out_w[good], out=np.full(len(ok), 0.0), where=out_w[good] > 0
            )
            fresh[open_] = good
            halvings[ok] = 0
            worse = open_[~good]
            step_b0[worse] *= 0.5
            step_u[worse] *= 0.5
            halvings[worse] += 1
            done = good & (gaps(open_) <= tol[open_])
            open_ = open_[~done]

        final = gaps(np.arange(k))
        for i, pr in enumerate(problems):
            pr.intercept, pr.beta = float(b0[i]), np.where(live[i], u[i] / sd[i], 0.0)
            pr.train_deviance = float(dev[i] / total_w[i])
            pr.held_out_deviance = float(out[i])
            pr.gap = float(final[i] / base[pr.held_out])
            pr.converged = bool(final[i] <= tol[i])

    def _refresh(self, problems, idx, b0, beta, score, gram, dev, out):
        s, g, d_, out_d, out_w = self._evaluate(
            [problems[i] for i in idx], b0[idx], beta[idx], not self.constant_weights
        )
        score[idx], dev[idx] = s, d_
        if g is not None:
            gram[idx] = g
        out[idx] = np.divide(out_d, out_w, out=np.zeros(len(idx)), where=out_w > 0)

    def _newton(self, idx, score, gram, u, sd, live, total_w, l1, l2, tol):
        """Step to the minimum of the local quadratic, intercept eliminated."""
        g0, g = score[idx, 0], score[idx, 1:]
        h00, h0, h = gram[idx, 0, 0], gram[idx, 0, 1:], gram[idx, 1:, 1:]
        if self.fit_intercept:
            safe = np.maximum(h00, 1e-300)
            h = h - h0[:, :, None] * h0[:, None, :] / safe[:, None, None]
            g = g - h0 * (g0 / safe)[:, None]
        on = np.where(live[idx], 1.0 / sd[idx], 0.0)
        h = h * on[:, :, None] * on[:, None, :] / total_w[idx, None, None]
        g = g * on / total_w[idx, None]
        v = u[idx]
        c = g + np.einsum("kij,kj->ki", h, v)
        target = solve_quadratics(h, c, v, l1[idx], l2[idx], 0.1 * tol[idx])
        step = target - v
        if not self.fit_intercept:
            return np.zeros(len(idx)), step
        return (g0 - (h0 * (step * on)).sum(1)) / safe, step


# ------------------------------------------------------------------------------- model


@dataclass
class GlmModel:
    """A fitted model; small enough to live on the driver and in a few table rows."""

    family: str
    blueprint: Blueprint
    predictors: list[str]
    features: list[Feature]
    coef: np.ndarray
    intercept: float
    alpha: float
    l1_ratio: float
    contributions: dict[str, list[float]]
    raw_slopes: dict[str, float] = field(default_factory=dict)
    fill: dict[str, float | None] = field(default_factory=dict)
    grid: list[tuple] = field(default_factory=list)
    fold_grid: list[tuple] = field(default_factory=list)
    train_deviance: float = math.nan
    gap: float = 0.0
    passes: int = 0
    _tables: dict[str, LevelTable] = field(default_factory=dict, repr=False)

    @property
    def n_params(self) -> int:
        return len(self.coef)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """One row per coefficient; features of a table of levels are named by joining it."""
        schema = "variable string, feature string, ord int, coef double"
        named, numbered = [("(Intercept)", "(Intercept)", 0, self.intercept)], []
        for i, (f, b) in enumerate(zip(self.features, self.coef)):
            plan = self.blueprint.get(f.variable)
            if plan is None or plan.table is None or f.name == f"{f.variable}_lumped[{OTHER}]":
                named.append((f.variable, f.name, i + 1, float(b)))
            else:
                # The name of such a feature has the position of its level.
                at = int(f.name.removeprefix(f"{f.variable}_lumped[").removesuffix("]"))
                numbered.append((f.variable, at, i + 1, float(b)))
        out = local_table(spark, named, schema)
        rest = local_table(spark, numbered, "variable string, at bigint, ord int, coef double")
        for v in dict.fromkeys(r[0] for r in numbered):
            levels = self.blueprint[v].table.table.select(F.col("level"), F.col("ord").alias("at"))
            name = F.concat(F.lit(f"{v}_lumped["), F.col("level"), F.lit("]")).alias("feature")
            out = out.unionByName(rest.where(F.col("variable") == v).join(levels, "at").select("variable", name, "ord", "coef"))
        return out

    def contribution_table(self, spark: SparkSession) -> DataFrame:
        """What each bin adds to the linear predictor."""
        rows = [
            (v, i, float(x)) for v, c in self.contributions.items() for i, x in enumerate(c)
        ]
        rows += [(v, None, float(x)) for v, x in self.raw_slopes.items()]
        return local_table(spark, rows, "variable string, bin int, contribution double")

    def grid_table(self, spark: SparkSession) -> DataFrame:
        """Mean held-out deviance of every penalty tried, and whether its fits converged in all folds."""
        return local_table(
            spark,
            [(*map(float, g[:3]), bool(g[3])) for g in self.grid],
            "l1_ratio double, alpha double, held_out_deviance double, converged boolean",
        )

    def fold_table(self, spark: SparkSession) -> DataFrame:
        """Held-out deviance per unit of weight of every penalty in every fold."""
        return local_table(
            spark, self.fold_grid,
            "l1_ratio double, alpha double, fold int, held_out_deviance double, held_out_weight double, converged boolean",
        )

    def effect_tables(self, spark: SparkSession) -> dict[str, LevelTable]:
        """Contributions of predictors with many levels as tables, written on first use."""
        for v, add in self.contributions.items():
            plan = self.blueprint[v]
            if v in self._tables or plan.kind == "numeric" or plan.table is None and plan.size <= CASE_LEVELS:
                continue
            if plan.table is None:
                rows = [(lv, i, float(a)) for i, (lv, a) in enumerate(zip(plan.levels, add))]
                levels = local_table(spark, rows, LEVEL_SCHEMA)
            else:
                values = local_table(spark, [(i, float(a)) for i, a in enumerate(add[:-1])], "ord bigint, value double")
                levels = plan.table.table.select("level", "ord").join(values, "ord")
            self._tables[v] = LevelTable.write(levels, float(add[-1]))
        return self._tables

    def linear_predictor(self, filled: Mapping[str, Column], looked_up: Mapping[str, Column] | None = None) -> Column:
        """Intercept plus one lookup per predictor, over columns with nulls filled.

        ``looked_up`` has the contributions that are already columns.
        """
        eta, looked_up = F.lit(float(self.intercept)), looked_up or {}
        for v, add in self.contributions.items():
            plan = self.blueprint[v]
            if v in looked_up:
                eta = eta + looked_up[v]
            elif not _varies(add):
                eta = eta + F.lit(float(add[0]))
            elif plan.kind == "numeric":
                x = filled.get(v, column(v).cast("double"))
                # A sparse fit changes at few breaks; the others need no comparison.
                cuts = [k for k in range(len(plan.breaks)) if add[k] != add[k + 1]]
                steps = lookup_range(x, [plan.breaks[k] for k in cuts], [*(add[k] for k in cuts), add[-1]])
                eta = eta + F.coalesce(steps, F.lit(add[-1]))
            else:
                values = {lv: F.lit(float(a)) for lv, a in zip(plan.levels, add)}
                eta = eta + lookup_level(
                    column(v).cast("string"), values, F.lit(float(add[-1]))
                )
        for v, slope in self.raw_slopes.items():
            eta = eta + F.lit(float(slope)) * filled.get(v, column(v).cast("double"))
        return eta

    def predict(
        self,
        df: DataFrame,
        output_col: str = "prediction",
        fill: str | Mapping[str, float | None] = "batch",
    ) -> DataFrame:
        """Add the predicted mean; one projection, no shuffle.

        Nulls take the mean of the batch as in the fit; ``fill="train"`` takes the
        means seen in the fit, which also works on a stream.
        """
        missing = [v for v in (*self.contributions, *self.raw_slopes) if v not in df.columns]
        if missing:
            raise ValueError(f"The data lacks the predictor '{missing[0]}'.")
        if isinstance(fill, str) and fill == "train":
            fill = self.fill
        numeric = [v for v, add in self.contributions.items() if self.blueprint[v].kind == "numeric" and _varies(add)]
        out, filled = fill_nulls(df, numeric + list(self.raw_slopes), fill)
        own = {v: f"__effect_{i}" for i, v in enumerate(self.effect_tables(df.sparkSession))}
        out = attach(out, [Lookup(column(v), self._tables[v], {c: "value"}) for v, c in own.items()])
        mean = inverse_link(self.linear_predictor(filled, {v: F.col(c) for v, c in own.items()}), self.family)
        return out.withColumn(output_col, mean).select(
            *[column(c) for c in df.columns if c != output_col], column(output_col)
        )


def _varies(add: Sequence[float]) -> bool:
    """Whether a predictor's bins add different amounts; if not, its value and its nulls do not matter."""
    return any(x != add[0] for x in add)


def fixed_model(
    model_type: str,
    blueprint: Blueprint | Mapping[str, Sequence],
    intercept: float,
    contributions: Mapping[str, Sequence[float]],
) -> GlmModel:
    """A model with given effects per bin instead of fitted ones."""
    blueprint = as_blueprint(blueprint)
    for v, c in contributions.items():
        if len(c) != blueprint[v].size:
            raise ValueError(f"'{v}' needs {blueprint[v].size} contributions, got {len(c)}")
    return GlmModel(
        family=family_name(model_type),
        blueprint=blueprint,
        predictors=list(contributions),
        features=[],
        coef=np.zeros(0),
        intercept=float(intercept),
        alpha=0.0,
        l1_ratio=1.0,
        contributions={v: [float(x) for x in c] for v, c in contributions.items()},
    )


def _passthrough_plans(
    df: DataFrame, names: Sequence[str], blueprint: Blueprint
) -> tuple[Blueprint, list[str], list[str]]:
    """Predictors with bins, and numeric predictors that enter as they are.

    A text predictor without a plan keeps all its levels, as a category.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    binned, raws, texts = [], [], []
    for v in names:
        if v in blueprint:
            if blueprint[v].kind == "error":
                raise ValueError(f"Column '{v}' has no usable plan: {blueprint[v].error}")
            if blueprint.usable(v):
                binned.append(v)
        elif isinstance(types[v], T.NumericType):
            raws.append(v)
        else:
            texts.append(v)
            binned.append(v)
    plans = dict(blueprint)
    if texts:
        for v, plan in level_plans(level_counts(df, texts), texts).items():
            plans[v] = plan if plan.kind == "categorical" else VariablePlan("categorical")
    return Blueprint(plans), binned, raws


@dataclass
class TrainingCells:
    """Checked training rows of a batch as packed cells, for several questions about one fit."""

    roles: tuple
    table: CellTable
    design: RangeDesign
    blueprint: Blueprint
    means: dict[str, float | None]

    @classmethod
    def build(
        cls, df: DataFrame, target: str, model_type: str, predictors: Sequence[str], blueprint: Blueprint | Mapping[str, Sequence], *,
        train_test_col: str = "traintest", weight_col: str | None = None, divide_target_by_weight: bool = False,
    ) -> TrainingCells:
        """What ``fit_glm`` and ``alpha_max`` with the same arguments would each make; every predictor needs a plan."""
        family = family_name(model_type)
        check_columns(df, predictors)
        if any(v not in blueprint for v in predictors):
            raise ValueError("Shared cells need a plan for every predictor.")
        blueprint, binned, raws = _passthrough_plans(df, predictors, as_blueprint(blueprint))
        numeric = [v for v in binned if blueprint[v].kind == "numeric"]
        validate_fit_input(df, target, train_test_col, family, weight_col)
        means: dict[str, float | None] = {}
        for i in range(0, len(numeric), MEANS_AT_ONCE):
            means |= mean_values(df, numeric[i : i + MEANS_AT_ONCE])
        y, w = _target(target, weight_col, divide_target_by_weight)
        train, bins = with_bins(df.where(column(train_test_col) == TRAIN_FLAG), binned, blueprint, means)
        design = RangeDesign(blueprint, binned, raws)
        roles = (target, family, tuple(predictors), train_test_col, weight_col, divide_target_by_weight)
        return cls(roles, CellTable.pack(train, bins, {}, y, w, family, design.layout), design, blueprint, means)

    def passes(self, target, family, predictors, train_test_col, weight_col, divide_target_by_weight) -> CellPasses:
        if self.roles != (target, family, tuple(predictors), train_test_col, weight_col, divide_target_by_weight):
            raise ValueError("The shared cells were made for other columns or another family.")
        return CellPasses(self.table, self.design, family, 1)

    def close(self) -> None:
        self.table.close()


def _target(target: str, weight_col: str | None, divide: bool) -> tuple[Column, Column]:
    w = column(weight_col).cast("double") if weight_col else F.lit(1.0)
    y = column(target).cast("double")
    return (F.try_divide(y, w) if divide and weight_col else y), w


def fit_glm(
    df: DataFrame,
    target: str,
    model_type: str,
    predictors: Sequence[str],
    blueprint: Blueprint | Mapping[str, Sequence],
    *,
    train_test_col: str = "traintest",
    weight_col: str | None = None,
    divide_target_by_weight: bool = False,
    use_cv: bool = True,
    cv_params: Mapping | None = None,
    alpha: float | None = None,
    l1_ratio: float = 1.0,
    drop_first: bool = False,
    fold_key: Sequence[str] | None = None,
    fold_col: str | None = None,
    fill: str | Mapping[str, float | None] = "batch",
    validate: bool = True,
    cells: TrainingCells | None = None,
) -> GlmModel:
    """Fit on the training rows of raw data that ``blueprint`` bins.

    With ``use_cv`` the penalty is the one of least mean held-out deviance over the
    grid, refitted on all training rows.  Without it the penalty is a pure L1 at the
    small end of the path, or at ``alpha`` and ``l1_ratio`` where given.

    A row's fold is ``fold_col`` (whole numbers, taken modulo the folds), else follows from a
    hash of ``fold_key``, else from a draw.  Only the first two are the same on every run.
    ``cv_params["solver"]`` is ``"dense"``, ``"active"`` (see ``wide``) or, by size, ``"auto"``.
    ``cells`` are those of the same rows, already checked, for a fit of the active solver without folds.
    """
    family = family_name(model_type)
    params = dict(cv_params or {})
    folds = int(params.pop("cv", None) or DEFAULT_FOLDS) if use_cv else 1
    l1_ratios = params.pop("l1_ratio", DEFAULT_L1_RATIOS)
    l1_ratios = [l1_ratios] if isinstance(l1_ratios, int | float) else list(l1_ratios)
    alphas = params.pop("alphas", None)
    n_alphas = int(params.pop("n_alphas", DEFAULT_N_ALPHAS))
    ratio = float(params.pop("min_alpha_ratio", None) or DEFAULT_MIN_ALPHA_RATIO)
    solver_kind = params.pop("solver", "auto")
    solver = {
        "fit_intercept": params.pop("fit_intercept", True),
        "scale_predictors": params.pop("scale_predictors", True),
        "max_iter": int(params.pop("max_iter", DEFAULT_MAX_ITER)),
        "tol": float(params.pop("gradient_tol", GRADIENT_TOL)),
    }
    if params:
        raise ValueError(f"Unknown fit parameters: {sorted(params)}")

    if solver_kind not in ("auto", "dense", "active"):
        raise ValueError("solver must be 'auto', 'dense' or 'active'")
    if cells is not None:
        if solver_kind != "active" or use_cv or drop_first or fill != "batch":
            raise ValueError("Shared cells serve the active solver without folds, over the batch's own means.")
        passes = cells.passes(target, family, predictors, train_test_col, weight_col, divide_target_by_weight)
        wide, design, blueprint, means, raws = True, cells.design, cells.blueprint, cells.means, []
        binned, table = design.binned, None
    else:
        if validate:
            check_columns(df, predictors)
        blueprint, binned, raws = _passthrough_plans(df, predictors, as_blueprint(blueprint))
        numeric = [v for v in binned if blueprint[v].kind == "numeric"] + raws
        # The batch is everything handed in, holdout rows included.
        given = not isinstance(fill, str)
        if validate:
            averages = [] if given else mean_aggregates(numeric)
            row = validate_fit_input(df, target, train_test_col, family, weight_col, averages)
        elif not given:
            row = df.agg(*mean_aggregates(numeric)).first() if numeric else {}
        means = dict(fill) if given else {v: row[f"m{i}"] for i, v in enumerate(numeric)}

        y, w = _target(target, weight_col, divide_target_by_weight)
        train = df.where(column(train_test_col) == TRAIN_FLAG)
        # Never of the target: a fold must not take all rows of one outcome.
        if fold_col is not None:
            fold = column(fold_col).cast("bigint")
        elif fold_key:
            fold = F.xxhash64(*[column(c) for c in fold_key])
        else:
            fold = F.floor(F.rand(FOLD_SEED) * (1 << 30))
        train, filled = fill_nulls(train, raws, means)
        train, bins = with_bins(train, binned, blueprint, means)
        raw_cols = {v: filled.get(v, column(v).cast("double")) for v in raws}

        wide = solver_kind == "active" or solver_kind == "auto" and _is_wide(blueprint, binned, raws)
        design = (RangeDesign if wide else Design)(blueprint, binned, raws, drop_first)
        fold = F.pmod(fold, F.lit(folds)) if folds > 1 else None
        if wide:
            table = CellTable.pack(train, bins, raw_cols, y, w, family, design.layout, fold, folds)
        else:
            sizes = [*design.layout.sizes, folds]
            table = CellTable.build(aggregate_cells(train, bins, raw_cols, y, w, family, fold=fold, sizes=sizes))
        passes = CellPasses(table, design, family, folds)
    try:
        fitter = (WideFitter if wide else Fitter)(passes, **solver)
        grid: list[tuple] = []
        fold_grid: list[tuple] = []
        if use_cv:
            chosen, grid, fold_grid = _cross_validate(
                fitter, folds, l1_ratios, alphas, n_alphas, ratio
            )
        else:
            if alpha is None:
                alpha = float(alpha_grid(fitter.null_gradient(), l1_ratio, 2, ratio)[-1])
            chosen = Problem(-1, float(l1_ratio), float(alpha))
            fitter.solve([chosen])
    finally:
        if table is not None:
            table.close()
    if not chosen.converged:
        warnings.warn(
            f"The fit stopped at {solver['max_iter']} iterations with a relative "
            f"optimality gap of {chosen.gap:.1e}.",
            stacklevel=2,
        )
    onehot = design.onehot_coefs(np.array([chosen.intercept]), chosen.beta[None, :])[0]
    layout = design.layout
    return GlmModel(
        family=family,
        blueprint=blueprint,
        predictors=list(predictors),
        features=[Feature(*n) for n in design.names] if wide else design.features,
        coef=chosen.beta,
        intercept=chosen.intercept,
        alpha=chosen.alpha,
        l1_ratio=chosen.l1_ratio,
        contributions={
            v: onehot[at : at + n].tolist()
            for v, at, n in zip(binned, layout.offsets, layout.sizes)
        },
        raw_slopes={v: float(onehot[layout.raw_at + j]) for j, v in enumerate(raws)},
        fill=means,
        grid=grid,
        fold_grid=fold_grid,
        train_deviance=chosen.train_deviance,
        gap=chosen.gap,
        passes=passes.count,
    )


def _is_wide(blueprint: Blueprint, binned: Sequence[str], raws: Sequence[str]) -> bool:
    sizes = [blueprint[v].size for v in binned]
    dim = 1 + sum(sizes) + len(raws)
    # Pairs of different predictors: half of the squared sum without the squares.
    packed = (sum(sizes) ** 2 - sum(n * n for n in sizes)) // 2 + dim * (1 + len(raws))
    return dim > DENSE_FEATURES or packed > DENSE_PACKED or any(blueprint[v].table is not None for v in binned)


def _cross_validate(fitter, folds, l1_ratios, alphas, n_alphas, ratio):
    """All folds and penalties at once; then the best penalty on all training rows."""
    empty = [f for f in range(folds) if not fitter.folds["w"][f] > 0]
    used = [f for f in range(folds) if f not in empty]
    if len(used) < 2:
        raise ValueError("Cross-validation needs at least two folds with training rows.")
    problems: dict[tuple[float, float], list[Problem]] = {}
    for rho in l1_ratios:
        grid = alphas if alphas is not None else alpha_grid(fitter.null_gradient(), rho, n_alphas, ratio)
        for a in grid:
            problems[float(rho), float(a)] = [
                Problem(f, float(rho), float(a)) for f in used
            ]
    fitter.solve([pr for group in problems.values() for pr in group])
    table = [
        (rho, a, float(np.mean([pr.held_out_deviance for pr in group])), all(pr.converged for pr in group))
        for (rho, a), group in problems.items()
    ]
    by_fold = [
        (rho, a, pr.held_out, pr.held_out_deviance, float(fitter.folds["w"][pr.held_out]), pr.converged)
        for (rho, a), group in problems.items() for pr in group
    ]
    usable = [row for row in table if math.isfinite(row[2])]
    if not usable:
        raise ValueError("No penalty of the grid gave a finite held-out deviance.")
    rho, a, *_ = min(usable, key=lambda row: (row[2], -row[1]))
    chosen = Problem(-1, rho, a)
    group = problems[rho, a]
    if all(pr.beta is not None for pr in group):
        chosen.intercept = float(np.mean([pr.intercept for pr in group]))
        chosen.beta = np.mean([pr.beta for pr in group], axis=0)
    fitter.solve([chosen])
    return chosen, table, by_fold


def alpha_max(
    df: DataFrame,
    target: str,
    model_type: str,
    predictors: Sequence[str],
    blueprint: Blueprint | Mapping[str, Sequence],
    *,
    train_test_col: str = "traintest",
    weight_col: str | None = None,
    divide_target_by_weight: bool = False,
    l1_ratio: float = 1.0,
    cells: TrainingCells | None = None,
) -> DataFrame:
    """``(feature, gradient, alpha)`` at the null model; the largest alpha zeroes all.

    ``gradient`` is the standardised null-model score per unit of weight, and ``alpha``
    the penalty at which that feature would enter.
    """
    model = as_blueprint(blueprint)
    family = family_name(model_type)
    if cells is not None:
        passes = cells.passes(target, family, predictors, train_test_col, weight_col, divide_target_by_weight)
        design, gradient = passes.design, WideFitter(passes).null_gradient()
    else:
        numeric = [v for v in predictors if model[v].kind == "numeric"]
        means = mean_values(df, numeric)
        y, w = _target(target, weight_col, divide_target_by_weight)
        train = df.where(column(train_test_col) == TRAIN_FLAG)
        train, bins = with_bins(train, predictors, model, means)
        # The null model needs no matrix, so the design by ranges does for any width.
        design = RangeDesign(model, predictors, [])
        sizes = design.layout.sizes
        # One pass is all it takes, so rows of many possible cells are read as they are.
        made = CellTable.unwritten if many_cells(sizes, ()) else CellTable.build
        table = made(aggregate_cells(train, bins, {}, y, w, family, sizes=sizes, once=True))
        try:
            gradient = WideFitter(CellPasses(table, design, family, 1)).null_gradient()
        finally:
            table.close()
    rows = [
        (variable, name, float(g), float(abs(g)) / l1_ratio if l1_ratio else None)
        for (variable, name), g in zip(design.names, gradient)
    ]
    return local_table(
        df.sparkSession, rows, "variable string, feature string, gradient double, alpha double"
    )


def fit_lasso_glm(
    dataframe: DataFrame,
    target: str,
    train_test_col: str,
    model_type: str,
    weight_col: str | None = None,
    divide_target_by_weight: bool = False,
    use_cv: bool = True,
    cv_params: Mapping | None = None,
    **options,
) -> GlmModel:
    """Fit on an already prepared table: every column without a role is a feature.

    Numbers enter as they are and texts as categories.  ``fit_glm`` on raw rows and a
    blueprint gives the same model and compresses better.
    """
    roles = {target, train_test_col, weight_col}
    features = [c for c in dataframe.columns if c not in roles]
    return fit_glm(
        dataframe,
        target,
        model_type,
        features,
        Blueprint({}),
        train_test_col=train_test_col,
        weight_col=weight_col,
        divide_target_by_weight=divide_target_by_weight,
        use_cv=use_cv,
        cv_params=cv_params,
        **options,
    )


def predict_with_model(
    model: GlmModel, new_data: DataFrame, output_col: str = "prediction", **options
) -> DataFrame:
    """Add the model's prediction to prepared or raw rows."""
    return model.predict(new_data, output_col, **options)
