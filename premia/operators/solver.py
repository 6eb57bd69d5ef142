"""The small dense half of the fit: penalised quadratics in as many unknowns as features.

All problems of a pass are solved side by side.  Coordinate sweeps find the signs, then
a direct solve on the non-zero coordinates finishes exactly.
"""

from __future__ import annotations

import numpy as np


def _soft(z, t):
    return np.sign(z) * np.maximum(np.abs(z) - t, 0.0)


def kkt_gap(q, u, l1, l2):
    """Largest violation of optimality; ``q`` is minus the smooth gradient at ``u``."""
    inner = q - l2[:, None] * u
    zero = np.maximum(np.abs(inner) - l1[:, None], 0.0)
    gap = np.where(u == 0, zero, np.abs(inner - l1[:, None] * np.sign(u)))
    return gap.max(axis=1) if gap.shape[1] else np.zeros(len(u))


def _sweep(h, diag, q, u, l1, l2):
    for j in range(u.shape[1]):
        old = u[:, j]
        bottom = diag[:, j] + l2
        new = np.divide(
            _soft(q[:, j] + diag[:, j] * old, l1),
            bottom,
            out=np.zeros_like(old),
            where=bottom > 1e-14,
        )
        step = new - old
        if step.any():
            q -= h[:, j, :] * step[:, None]
            u[:, j] = new


def _on_support(h, diag, c, u, l1, l2, rounds=40):
    """Move to the minimum over the current signs; a coordinate that reaches 0 stays."""
    k, p = u.shape
    busy = np.arange(k)
    for _ in range(rounds):
        if not len(busy):
            break
        v = u[busy]
        on = v != 0
        sign = np.sign(v)
        m = np.where(on[:, :, None] & on[:, None, :], h[busy], 0.0)
        exact = np.where(on, diag[busy] + l2[busy, None], 1.0)
        # Collinear features make the system singular: a trace of ridge, then one
        # correction against the system without it.
        ridge = np.where(on, 1e-12 * diag[busy] + 1e-200, 0.0)
        m[:, np.arange(p), np.arange(p)] = exact + ridge
        rhs = np.where(on, c[busy] - l1[busy, None] * sign, 0.0)
        target = np.linalg.solve(m, rhs[:, :, None])
        rest = rhs[:, :, None] - m @ target + ridge[:, :, None] * target
        target = (target + np.linalg.solve(m, rest))[:, :, 0]
        crossing = on & (sign * target < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(crossing, v / (v - target), np.inf)
        step = np.minimum(t.min(axis=1), 1.0) if p else np.ones(len(busy))
        moved = v + step[:, None] * (target - v)
        moved[~on] = 0.0
        moved[crossing & (t <= step[:, None])] = 0.0
        u[busy] = moved
        busy = busy[crossing.any(axis=1)]


def solve_quadratics(h, c, u0, l1, l2, tol, rounds=200):
    """For each k minimise u'Hu/2 - c'u + l1|u| + l2 u'u/2, starting from ``u0``."""
    u = u0.copy()
    p = u.shape[1]
    if p == 0:
        return u
    diag = h[:, np.arange(p), np.arange(p)]
    open_ = np.arange(len(u))
    best = np.full(len(u), np.inf)
    stalls = np.zeros(len(u), dtype=int)
    for _ in range(rounds):
        hk, dk, ck, uk = h[open_], diag[open_], c[open_], u[open_]
        a, b = l1[open_], l2[open_]
        q = ck - np.einsum("kij,kj->ki", hk, uk)
        for _sweep_no in range(4):
            _sweep(hk, dk, q, uk, a, b)
        _on_support(hk, dk, ck, uk, a, b)
        u[open_] = uk
        q = ck - np.einsum("kij,kj->ki", hk, uk)
        gap = kkt_gap(q, uk, a, b)
        # At the limit of the arithmetic the gap stops falling; the next pass goes on.
        stalls[open_] = np.where(gap < 0.5 * best[open_], 0, stalls[open_] + 1)
        best[open_] = np.minimum(best[open_], gap)
        open_ = open_[(gap > tol[open_]) & (stalls[open_] < 8)]
        if not len(open_):
            break
    return u
