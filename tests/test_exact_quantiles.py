"""Exact quantile regression: group quantiles, optimality of the check loss, vertices through rows."""

import numpy as np
import pandas as pd
import pytest

from gramwise.operators.iterate import quantile_regression
from gramwise.operators.vertex import vertex_descent


def loss(theta, x, y, w, tau):
    r = y - x @ theta
    return (w * np.where(r < 0, tau - 1, tau) * r).sum()


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.83])
def test_descent_equals_search_over_all_vertices(tau):
    rng = np.random.default_rng(3)
    for ties in (False, True):
        x = np.column_stack([np.ones(24), rng.integers(0, 4, 24) if ties else rng.normal(size=24)])
        y, w = (rng.integers(0, 5, 24).astype(float) if ties else rng.normal(size=24)), rng.random(24) + 0.1
        slope = rng.normal(size=2) * 0.2
        best = min(loss(t, x, y, w, tau) + slope @ t for i in range(24) for j in range(i) if abs(np.linalg.det(x[[i, j]])) > 1e-9 for t in [np.linalg.solve(x[[i, j]], y[[i, j]])])
        theta, reached = vertex_descent(x, y, w, tau, np.zeros(2), slope)
        assert reached and loss(theta, x, y, w, tau) + slope @ theta == pytest.approx(best, abs=1e-8)


@pytest.mark.parametrize("tau", [0.25, 0.5, 0.9])
def test_binary_covariate_gives_the_two_group_quantiles(spark, tau):
    rng = np.random.default_rng(4)
    # group sizes of which no level is a whole number, so that the minimum is unique
    g = (np.arange(4002) < 1335).astype(float)
    y = rng.lognormal(size=4002) + 5 * g
    df = spark.createDataFrame(pd.DataFrame({"g": g, "y": y}))
    theta, status = quantile_regression(df, ["g"], "y", tau)
    low, high = (np.sort(y[g == k])[int(np.ceil(tau * (g == k).sum() - 1e-9)) - 1] for k in (0, 1))
    assert status == "ok" and theta == pytest.approx([low, high - low], abs=1e-9)


def test_many_columns_weights_and_offsets_reach_the_minimum(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.normal(size=(n, 3)) + [0, 1e6, 0]
    y = x @ [1.0, -2.0, 0.5] + rng.standard_t(2, size=n) * (1 + np.abs(x[:, 0]))
    w = rng.random(n) + 0.2
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": w}))
    theta, status = quantile_regression(df, ["a", "b", "c"], "y", 0.3, "w")
    assert status == "ok"
    z = np.column_stack([np.ones(n), x - [0, 1e6, 0]])
    at = np.concatenate(([theta[0] + 1e6 * theta[2]], theta[1:]))
    shifted = y - z @ at
    on = np.abs(shifted) < 1e-6
    assert on.sum() == 4
    # at the minimum a combination within [tau - 1, tau] of the rows on the fit balances all others
    side = np.where(shifted < 0, 0.7, -0.3) * w
    balance = np.linalg.solve(z[on].T, -(side[~on] @ z[~on]))
    assert (balance <= 0.7 * w[on] + 1e-6).all() and (balance >= -0.3 * w[on] - 1e-6).all()
