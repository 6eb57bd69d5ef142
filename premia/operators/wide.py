"""Fits with more features than a dense matrix over all of them should hold.

Passes over the cells bring back scores, which are as long as the features.  Curvature is
asked for only between the features that are or should become non-zero (the active set), so
neither the driver nor a task holds a matrix over all features.  A penalty that leaves too
many of them active (a pure ridge, say) is solved from scores alone, by an orthant-wise
quasi-Newton method with a short memory.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from premia.functions.binning import OTHER
from premia.operators import kernels
from premia.operators.blueprint import Blueprint

#: Features that share a matrix at most.
ACTIVE_LIMIT = 1_200
#: Features that join the active set at once, or as many as are active already.
GROWTH = 64
#: Steps whose changes of score the quasi-Newton method remembers.
MEMORY = 12
#: Optimality, relative to the null model, at which the quasi-Newton method stops.
QUASI_TOL = 1e-7
#: Steps without a clearly smaller gap or objective after which it gives up.
PATIENCE = 40
#: Doubles of coefficients that are kept for later fits at most.
KEPT_COEFS = 50_000_000


class RangeDesign:
    """Features as ranges of the one-hot vector; nothing is of the size of a matrix.

    Feature j sums the one-hot entries ``lo[j]`` to ``hi[j]``; entry 0 is the intercept.
    """

    def __init__(self, blueprint: Blueprint, binned: Sequence[str], raws: Sequence[str], drop_first: bool = False):
        self.binned, self.raws = list(binned), list(raws)
        self.layout = kernels.Layout([blueprint[v].size for v in binned], len(raws))
        names: list[tuple[str, str]] = []
        lo, hi = [], []
        for v, at, size in zip(self.binned, self.layout.offsets, self.layout.sizes):
            plan = blueprint[v]
            if plan.kind == "numeric":
                names += [(v, f"{v}{b}") for b in plan.breaks]
                lo.append(np.full(size - 1, at))
                hi.append(at + 1 + np.arange(size - 1))
            else:
                first = 1 if drop_first else 0
                shown = [str(j) for j in range(size - 1)] if plan.table is not None else plan.levels
                names += [(v, f"{v}_lumped[{lv}]") for lv in (*shown, OTHER)[first:]]
                lo.append(at + np.arange(first, size))
                hi.append(at + 1 + np.arange(first, size))
        for j, v in enumerate(self.raws):
            names.append((v, v))
            lo.append(np.array([self.layout.raw_at + j]))
            hi.append(np.array([self.layout.raw_at + j + 1]))
        none = np.zeros(0, np.int64)
        self.names = names
        self.lo, self.hi = (np.concatenate([none, *x]).astype(np.int64) for x in (lo, hi))

    @property
    def p(self) -> int:
        return len(self.lo)

    def score(self, onehot: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((len(onehot), 1)), np.cumsum(onehot, axis=1)], axis=1)
        # Sums of one entry are taken as they are: a difference of long sums would lose digits.
        own = np.where(self.hi - self.lo == 1, onehot[:, self.lo], sums[:, self.hi] - sums[:, self.lo])
        return np.column_stack([onehot[:, :1], own])

    def onehot_coefs(self, intercept: np.ndarray, beta: np.ndarray) -> np.ndarray:
        steps = np.zeros((len(beta), self.layout.dim + 1))
        for row, b in zip(steps, beta):
            on = np.flatnonzero(b)
            np.add.at(row, self.lo[on], b[on])
            np.add.at(row, self.hi[on], -b[on])
        out = np.cumsum(steps[:, :-1], axis=1)
        # The running sum leaves residues of rounding where no feature reaches.
        for k, b in enumerate(beta):
            on = np.flatnonzero(b)
            reach = np.zeros(self.layout.dim + 1, np.int64)
            np.add.at(reach, self.lo[on], 1)
            np.add.at(reach, self.hi[on], -1)
            out[k, np.cumsum(reach[:-1]) == 0] = 0.0
        out[:, 0] = intercept
        return out

    def columns(self, features: np.ndarray) -> list[tuple[int, int, int]]:
        """(predictor, from bin, to bin) of features, or (-1 - raw column, 0, 0)."""
        starts = np.array([*self.layout.offsets, self.layout.raw_at])
        out = []
        for j in features:
            lo, hi = int(self.lo[j]), int(self.hi[j])
            if lo >= self.layout.raw_at:
                out.append((-1 - (lo - self.layout.raw_at), 0, 0))
            else:
                v = int(np.searchsorted(starts, lo, "right")) - 1
                out.append((v, lo - int(starts[v]), hi - int(starts[v])))
        return out


class WideFitter:
    """Solves the same problems as the dense fitter, see the module's head."""

    def __init__(self, passes, fit_intercept=True, scale_predictors=True, max_iter=150, tol=1e-9):
        self.passes, self.design = passes, passes.design
        self.family = passes.family
        self.fit_intercept, self.scale = fit_intercept, scale_predictors
        self.max_iter, self.tol = max_iter, tol
        self.p = self.design.p
        self.folds = passes.light_moments()
        self._by_fold: dict[int, dict] = {}

    # ------------------------------------------------------------------ null models

    def train(self, held_out: int) -> dict:
        if held_out not in self._by_fold:
            keep = np.arange(self.passes.n_folds) != held_out
            m = {k: v[keep].sum(axis=0) for k, v in self.folds.items()}
            mean = m["wx"][1:] / m["w"]
            var = m["sq"] / m["w"] - mean**2
            live = var > 1e-12 * np.maximum(1.0, mean**2)
            if not self.fit_intercept:
                live = m["sq"] > 0
            m["sd"] = np.sqrt(np.where(live, var, 1.0)) if self.scale else np.ones(self.p)
            m["sd"] = np.where(m["sd"] > 0, m["sd"], 1.0)
            m["live"] = live
            m["null"] = _link(m["xy"][0] / m["w"], self.family) if self.fit_intercept else 0.0
            mu = kernels.mean_of(np.array([m["null"]]), self.family)[0]
            score = kernels.residual(m["wx"], m["xy"], mu, self.family)
            m["gradient"] = np.where(live, score[1:] / m["sd"] / m["w"], 0.0)
            self._by_fold[held_out] = m
        return self._by_fold[held_out]

    def null_gradient(self, held_out: int = -1) -> np.ndarray:
        return self.train(held_out)["gradient"]

    def alpha_max(self, l1_ratio: float, ridge: float) -> float:
        return ridge if l1_ratio == 0 else float(np.abs(self.null_gradient()).max(initial=0.0) / l1_ratio)

    # ---------------------------------------------------------------------- solving

    def solve(self, problems: Sequence) -> None:
        """Along each path of falling penalties, all folds and ratios side by side."""
        paths: dict[tuple, list] = {}
        for pr in sorted(problems, key=lambda pr: -pr.alpha):
            paths.setdefault((pr.held_out, pr.l1_ratio), []).append(pr)
        for stage in range(max((len(x) for x in paths.values()), default=0)):
            now = [x[stage] for x in paths.values() if stage < len(x)]
            for x in paths.values():
                if 0 < stage < len(x) and x[stage].beta is None:
                    x[stage].intercept, x[stage].beta = x[stage - 1].intercept, x[stage - 1].beta
            self._solve(now)
            if self.p * len(problems) > KEPT_COEFS and stage:
                for x in paths.values():
                    if stage < len(x):
                        x[stage - 1].beta = None

    def _solve(self, problems: list) -> None:
        state = _State(self, problems)
        state.look(np.arange(len(problems)))
        many = np.zeros(len(problems), bool)
        for _ in range(self.max_iter):
            todo = state.open(self.tol)
            todo = todo[~many[todo]]
            if not len(todo):
                break
            active = [state.active(k) for k in todo]
            full = np.array([len(a) > ACTIVE_LIMIT for a in active])
            many[todo[full]] = True
            todo, active = todo[~full], [a for a, f in zip(active, full) if not f]
            if len(todo):
                state.newton(todo, active, self.tol)
        if many.any():
            state.quasi_newton(np.flatnonzero(many), 2 * self.max_iter)
        state.finish(self.tol, many)


def _link(mean: float, family: str) -> float:
    if family == "gaussian":
        return float(mean)
    if family == "binomial":
        mean = min(max(mean, 1e-12), 1 - 1e-12)
        return math.log(mean / (1 - mean))
    return math.log(max(mean, 1e-300))


class _State:
    """Where a batch of problems stands; coefficients ``u`` are on standardised features."""

    def __init__(self, fitter: WideFitter, problems: list):
        self.f, self.problems = fitter, problems
        k, p = len(problems), fitter.p
        train = [fitter.train(pr.held_out) for pr in problems]
        self.w = np.array([m["w"] for m in train])
        self.sd = np.array([m["sd"] for m in train]).reshape(k, p)
        self.live = np.array([m["live"] for m in train]).reshape(k, p)
        self.base = np.array([max(np.abs(m["gradient"]).max(initial=0.0), 1e-12) for m in train])
        self.l1 = np.array([pr.alpha * pr.l1_ratio for pr in problems])
        self.l2 = np.array([pr.alpha * (1 - pr.l1_ratio) for pr in problems])
        warm = [pr.beta is not None for pr in problems]
        self.b0 = np.array([pr.intercept if x else m["null"] for pr, x, m in zip(problems, warm, train)], float)
        self.u = np.array([pr.beta if x else np.zeros(p) for pr, x in zip(problems, warm)]).reshape(k, p) * self.sd * self.live
        self.score, self.q0 = np.zeros((k, p)), np.zeros(k)
        self.dev, self.value, self.out = np.zeros(k), np.zeros(k), np.zeros(k)

    def _pass(self, idx, b0, u):
        held = [self.problems[i].held_out for i in idx]
        score, _, dev, out_dev, out_w = self.f.passes.evaluate(b0, u / self.sd[idx], held, False)
        q = np.where(self.live[idx], score[:, 1:] / self.sd[idx] / self.w[idx, None], 0.0)
        out = np.divide(out_dev, out_w, out=np.zeros(len(idx)), where=out_w > 0)
        value = dev / (2 * self.w[idx]) + self.l1[idx] * np.abs(u).sum(1) + 0.5 * self.l2[idx] * (u * u).sum(1)
        q0 = score[:, 0] / self.w[idx] if self.f.fit_intercept else np.zeros(len(idx))
        return q, q0, dev, out, value

    def look(self, idx) -> None:
        self.score[idx], self.q0[idx], self.dev[idx], self.out[idx], self.value[idx] = self._pass(idx, self.b0[idx], self.u[idx])

    def gaps(self) -> np.ndarray:
        inner = self.score - self.l2[:, None] * self.u
        l1 = self.l1[:, None]
        gap = np.where(self.u == 0, np.maximum(np.abs(inner) - l1, 0.0), np.abs(inner - l1 * np.sign(self.u)))
        return np.maximum(gap.max(axis=1, initial=0.0), np.abs(self.q0)) / self.base

    def open(self, tol) -> np.ndarray:
        return np.flatnonzero(self.gaps() > tol)

    def active(self, k) -> np.ndarray:
        """Features that are not zero, and those that most want not to be."""
        on = np.flatnonzero(self.u[k])
        excess = np.where((self.u[k] == 0) & self.live[k], np.abs(self.score[k]) - self.l1[k], 0.0)
        wanting = np.flatnonzero(excess > 0)
        most = max(GROWTH, len(on))
        if len(wanting) > most:
            wanting = wanting[np.argsort(-excess[wanting])[:most]]
        return np.union1d(on, wanting)

    def _try(self, idx, step_b0, step_u) -> None:
        """Whole steps, or halves of them for problems that would get worse."""
        left, size = np.arange(len(idx)), np.ones(len(idx))
        for trial in range(40):
            at = idx[left]
            b0 = self.b0[at] + size[left] * step_b0[left]
            u = self.u[at] + size[left, None] * step_u[left]
            u[np.abs(u) < 1e-14] = 0.0
            q, q0, dev, out, value = self._pass(at, b0, u)
            good = value <= self.value[at] + 1e-12 * np.maximum(1.0, np.abs(self.value[at]))
            good |= trial == 39
            ok = at[good]
            self.b0[ok], self.u[ok] = b0[good], u[good]
            self.score[ok], self.q0[ok], self.dev[ok], self.out[ok], self.value[ok] = q[good], q0[good], dev[good], out[good], value[good]
            left = left[~good]
            if not len(left):
                return
            size[left] *= 0.5

    def newton(self, idx, active, tol) -> None:
        """One step to the minimum of the local quadratic over each active set."""
        from premia.operators.solver import solve_quadratics

        held = [self.problems[i].held_out for i in idx]
        grams = self.f.passes.active_grams(self.b0[idx], self.u[idx] / self.sd[idx], held, active)
        step_b0, step_u = np.zeros(len(idx)), np.zeros((len(idx), self.f.p))
        for j, (k, on, gram) in enumerate(zip(idx, active, grams)):
            gram = gram / self.w[k]
            scale = np.concatenate([[1.0], 1.0 / self.sd[k, on]])
            gram = gram * scale[:, None] * scale[None, :]
            h00, h0, h = max(gram[0, 0], 1e-300), gram[0, 1:], gram[1:, 1:]
            g = self.score[k, on]
            if self.f.fit_intercept:
                h, g = h - np.outer(h0, h0) / h00, g - h0 * self.q0[k] / h00
            v = self.u[k, on]
            c = g + h @ v
            goal = solve_quadratics(h[None], c[None], v[None], self.l1[k : k + 1], self.l2[k : k + 1], np.array([0.1 * tol * self.base[k]]))[0]
            step_u[j, on] = goal - v
            if self.f.fit_intercept:
                step_b0[j] = (self.q0[k] - h0 @ (goal - v)) / h00
        self._try(idx, step_b0, step_u)

    # ------------------------------------------------------- without any curvature

    def _pseudo(self, idx):
        """Minus the steepest subgradient, intercept first."""
        u, l1 = self.u[idx], self.l1[idx, None]
        inner = self.score[idx] - self.l2[idx, None] * u
        free = np.sign(inner) * np.maximum(np.abs(inner) - l1, 0.0)
        g = np.where(u == 0, free, inner - l1 * np.sign(u))
        return np.column_stack([self.q0[idx], g])

    def quasi_newton(self, idx, rounds: int) -> None:
        memory: dict[int, list] = {int(k): [] for k in idx}
        best, lowest = np.full(len(self.problems), np.inf), np.full(len(self.problems), np.inf)
        stalled = np.zeros(len(self.problems), int)
        for _ in range(rounds):
            gap = self.gaps()
            better = (gap[idx] < 0.9 * best[idx]) | (lowest[idx] - self.value[idx] > 1e-12 * np.abs(self.value[idx]))
            best[idx] = np.minimum(best[idx], gap[idx])
            lowest[idx] = np.minimum(lowest[idx], self.value[idx])
            stalled[idx] = np.where(better, 0, stalled[idx] + 1)
            # At the limit of the arithmetic the gap stops falling.
            todo = idx[(gap[idx] > QUASI_TOL) & (stalled[idx] < PATIENCE)]
            if not len(todo):
                return
            g = self._pseudo(todo)
            d = np.array([_two_loops(memory[int(k)], x) for k, x in zip(todo, g)])
            d = np.where((d * g > 0) | (self.l1[todo, None] == 0), d, 0.0)
            if not self.f.fit_intercept:
                d[:, 0] = 0.0
            orthant = np.where(self.u[todo] != 0, np.sign(self.u[todo]), np.sign(g[:, 1:]))
            before_u, before_b0 = self.u[todo].copy(), self.b0[todo].copy()
            smooth = np.column_stack([self.q0[todo], self.score[todo] - self.l2[todo, None] * self.u[todo]])
            left, size = np.arange(len(todo)), np.ones(len(todo))
            for k, i in enumerate(todo):
                if not memory[int(i)]:
                    size[k] = min(1.0, 1.0 / max(np.abs(g[k]).sum(), 1e-300))
            for trial in range(40):
                at = todo[left]
                u = before_u[left] + size[left, None] * d[left, 1:]
                crossed = (self.l1[at, None] > 0) & (u * orthant[left] < 0)
                u[crossed] = 0.0
                b0 = before_b0[left] + size[left] * d[left, 0]
                q, q0, dev, out, value = self._pass(at, b0, u)
                gain = ((u - before_u[left]) * g[left, 1:]).sum(1) + (b0 - before_b0[left]) * g[left, 0]
                # Differences below rounding do not tell whether a step is good.
                good = value <= self.value[at] - 1e-4 * gain + 1e-14 * np.abs(self.value[at])
                good |= trial == 39
                ok = at[good]
                self.b0[ok], self.u[ok] = b0[good], u[good]
                self.score[ok], self.q0[ok], self.dev[ok], self.out[ok], self.value[ok] = q[good], q0[good], dev[good], out[good], value[good]
                left = left[~good]
                if not len(left):
                    break
                size[left] *= 0.5
            after = np.column_stack([self.q0[todo], self.score[todo] - self.l2[todo, None] * self.u[todo]])
            for j, k in enumerate(todo):
                s = np.concatenate([[self.b0[k] - before_b0[j]], self.u[k] - before_u[j]])
                y = smooth[j] - after[j]
                if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
                    memory[int(k)] = [*memory[int(k)], (s, y)][-MEMORY:]

    def finish(self, tol, many) -> None:
        gaps = self.gaps()
        for k, pr in enumerate(self.problems):
            pr.intercept = float(self.b0[k])
            pr.beta = np.where(self.live[k], self.u[k] / self.sd[k], 0.0)
            pr.train_deviance = float(self.dev[k] / self.w[k])
            pr.held_out_deviance = float(self.out[k])
            pr.gap = float(gaps[k])
            pr.converged = bool(gaps[k] <= (max(tol, QUASI_TOL) if many[k] else tol))


def _two_loops(pairs: list, g: np.ndarray) -> np.ndarray:
    """The quasi-Newton direction for minus gradient ``g``."""
    if not pairs:
        return g.copy()
    d, notes = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ d) / (s @ y)
        notes.append(a)
        d = d - a * y
    s, y = pairs[-1]
    d *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(notes)):
        d += s * (a - (y @ d) / (s @ y))
    return d
