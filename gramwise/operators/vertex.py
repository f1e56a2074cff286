"""Exact minima of the check loss: rows far from the fit only tell their side, the few near it decide.

Quantile regression is a linear program whose minimum passes through as many rows as there are coefficients. From a good
start, rows further from the fit than a band keep the sign of their residual, so their loss is linear: its slope is one
aggregate. The rows within the band, whose number is bounded, are fetched, and the minimum over both parts is found by
descent from vertex to vertex. A pass over all rows then checks the signs; if some changed, the band moves along.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gramwise.operators.moments import linear_score

MOST_ROWS = 50_000
"""Rows fetched for one exact descent."""


def _first_basis(x: np.ndarray, distance: np.ndarray) -> np.ndarray | None:
    """Rows nearest to the fit that are linearly independent."""
    k, chosen = x.shape[1], []
    left = np.zeros((0, k))
    scale = np.abs(x).max(axis=0)
    scaled = x / np.where(scale > 0, scale, 1.0)
    for i in np.argsort(distance, kind="stable"):
        rest = scaled[i] - left.T @ (left @ scaled[i])
        size = np.linalg.norm(rest)
        if size > 1e-7 * max(np.linalg.norm(scaled[i]), 1e-300):
            left = np.vstack([left, rest / size])
            chosen.append(i)
            if len(chosen) == k:
                return np.array(chosen)
    return None


def vertex_descent(x: np.ndarray, y: np.ndarray, w: np.ndarray, tau: float, start: np.ndarray, slope: np.ndarray, most_steps: int = 5000) -> tuple[np.ndarray, bool]:
    """The minimum of sum(w check(y - x theta)) + slope theta for positive weights, and whether it was reached.

    Along each edge of a vertex the loss is convex and piecewise linear: the exact step ends at the row where its slope
    turns, the weighted median of the ratios. Ties are told apart by a tiny fixed disturbance of y; the basis found is
    also one of the undisturbed program.
    """
    n, k = x.shape
    spread = np.abs(y - x @ start).max() if n else 0.0
    disturbed = y + 1e-10 * max(spread, 1e-300) * np.random.default_rng(0).permutation(np.arange(1, n + 1)) / max(n, 1)
    basis = _first_basis(x, np.abs(y - x @ start))
    if basis is None:
        return start, False
    for _ in range(most_steps):
        inverse = np.linalg.inv(x[basis])
        theta = inverse @ disturbed[basis]
        r = disturbed - x @ theta
        r[basis] = 0.0
        side = np.where(r < 0, 1.0 - tau, -tau) * w
        side[basis] = 0.0
        # along +edge j the residual of basis row j turns negative, along -edge j positive
        rest = (slope + side @ x) @ inverse
        rates = np.concatenate((rest + w[basis] * (1.0 - tau), -rest + w[basis] * tau))
        j = int(rates.argmin())
        if rates[j] >= -1e-10 * (np.abs(rest).max() + w[basis].max()):
            return np.linalg.solve(x[basis], y[basis]), True
        edge = inverse[:, j % k] * (1.0 if j < k else -1.0)
        moves = x @ edge
        moves[basis] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(moves != 0, r / moves, np.inf)
        steps[~(steps > 0)] = np.inf
        order = np.argsort(steps, kind="stable")
        rising = rates[j] + np.cumsum(w[order] * np.abs(moves[order]))
        at = int(np.searchsorted(rising >= 0, True))
        if at == n or not np.isfinite(steps[order[at]]):
            return theta, False
        basis[j % k] = order[at]
    return theta, False


def exact_quantile_fit(rows: DataFrame, names: Sequence[str], y: str, w: str, tau: float, theta: np.ndarray, band: float, most_rows: int = MOST_ROWS, rounds: int = 30) -> tuple[np.ndarray, str]:
    """(theta, status) of the exact fit from a start close to it; all weights must be positive. Rows with a null or NaN
    must have been left out. Status 'ok' means that a pass over all rows has confirmed the minimum."""
    theta = np.asarray(theta, float)
    inputs = [F.lit(1.0), *[F.col(n) for n in names]]
    for _ in range(rounds):
        u = F.col(y) - linear_score(theta, names)
        for _ in range(60):
            # slope of the loss of all rows outside the band, and how many lie within
            side = F.when(u < -band, F.col(w) * (1.0 - tau)).when(u > band, -F.col(w) * tau).otherwise(0.0)
            sums = rows.agg(F.count_if(F.abs(u) <= band).alias("n"), F.count(F.lit(1)).alias("all"), *[F.sum(side * z).alias(f"s{i}") for i, z in enumerate(inputs)]).first()
            if sums["n"] > most_rows:
                band *= 0.7 * most_rows / sums["n"]
            elif sums["n"] < min(sums["all"], 50 * len(inputs)):
                band *= 4.0
            else:
                break
        near = rows.where(F.abs(u) <= band).select(F.array(*inputs[1:]).alias("x"), y, w).limit(2 * most_rows).collect() if len(inputs) > 1 else rows.where(F.abs(u) <= band).select(F.array().cast("array<double>").alias("x"), y, w).limit(2 * most_rows).collect()
        if len(near) != sums["n"]:
            return theta, "not converged"
        x = np.column_stack([np.ones(len(near)), np.array([r[0] for r in near], float).reshape(len(near), len(names))])
        slope = np.array([float(sums[f"s{i}"] or 0.0) for i in range(len(inputs))])
        found, reached = vertex_descent(x, np.array([r[1] for r in near], float), np.array([r[2] for r in near], float), tau, theta, slope)
        if not reached:
            # the minimum of this part lies outside the band: widen it where that is allowed
            if 4 * sums["n"] > most_rows:
                return theta, "not converged"
            band *= 4.0
            continue
        v = F.col(y) - linear_score(found, names)
        crossed = rows.where((F.abs(u) > band) & (F.signum(u) * v < 0)).limit(1).count()
        theta = found
        if not crossed:
            return theta, "ok"
    return theta, "not converged"
