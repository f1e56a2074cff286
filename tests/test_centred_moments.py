"""Fits on columns far from zero, and centred sums against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators import iterate, ranks
from gramwise.operators.centred import _Sums, centred_moments
from gramwise.operators.moments import least_squares, out_of_fold_least_squares


def test_line_far_from_zero(spark):
    df = spark.range(20_000).select(((F.col("id") / 20_000) + 1e8).alias("x"), (3.0 * F.col("id") / 20_000).alias("y"))
    fit = least_squares(df, ["x"], "y").first()
    assert fit["status"] == "ok" and fit["theta"][1] == pytest.approx(3.0, rel=1e-6)
    assert fit["theta"][0] + fit["theta"][1] * 1e8 == pytest.approx(0.0, abs=1e-5)


def test_groups_far_from_each_other_folds_and_weights(spark):
    rng = np.random.default_rng(2)
    n = 3000
    g = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2)) + np.array([0.0, 1e9, -1e7])[g][:, None]
    y = 2.0 + x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    w = rng.normal(size=n) + 0.8
    pdf = pd.DataFrame({"grp": [None if k == 2 else f"g{k}" for k in g], "a": x[:, 0], "b": x[:, 1], "y": y, "w": w, "fold": np.arange(n) % 3})
    df = spark.createDataFrame(pdf, "grp string, a double, b double, y double, w double, fold int").repartition(5)

    def expected(rows, weights):
        c = x[rows].mean(axis=0)
        z = np.column_stack([np.ones(rows.sum()), x[rows] - c])
        return np.linalg.solve(z.T @ (z * weights[rows, None]), z.T @ (weights[rows] * y[rows]))[1:]

    fits = {r["grp"]: r for r in least_squares(df, ["a", "b"], "y", "w", by=["grp"]).collect()}
    for k, name in enumerate(["g0", "g1", None]):
        assert fits[name]["n"] == (g == k).sum()
        assert fits[name]["theta"][1:] == pytest.approx(expected(g == k, w), abs=1e-5)
    held = {(r["grp"], r["fold"]): r["theta"][1:] for r in out_of_fold_least_squares(df, ["a", "b"], "y", "fold", by=["grp"]).collect()}
    assert len(held) == 9
    for k, name in enumerate(["g0", "g1", None]):
        for f in range(3):
            assert held[name, f] == pytest.approx(expected((g == k) & (pdf["fold"].to_numpy() != f), np.ones(n)), abs=1e-5)


def test_logistic_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    pdf = pd.DataFrame({"x": x, "far": x + 1e9, "y": (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + x)))).astype(float), "grp": rng.integers(0, 2, 4000)})
    df = spark.createDataFrame(pdf)
    for start in ("zero", "linear"):
        near, far = (iterate.logistic_regression(df, [c], "y", start=start).first() for c in ("x", "far"))
        assert far["status"] == "ok" and far["theta"][1] == pytest.approx(near["theta"][1], rel=1e-5)
        near, far = ({r["grp"]: r for r in iterate.logistic_regression(df, [c], "y", by=["grp"], start=start).collect()} for c in ("x", "far"))
        assert all(far[k]["status"] == "ok" and far[k]["theta"][1] == pytest.approx(near[k]["theta"][1], rel=1e-5) for k in (0, 1))


def test_merging_in_any_order_gives_the_same_sums():
    rng = np.random.default_rng(4)
    x, r, w = rng.normal(size=(300, 2)) + 50, rng.normal(size=(300, 1)), rng.normal(size=300)

    def state(rows):
        c = x[rows].mean(axis=0)
        z = np.column_stack([np.ones(len(rows)), x[rows] - c])
        return np.array([float(len(rows))]), c[None], (z.T @ (z * w[rows, None]))[None], (r[rows].T @ z)[None], np.zeros((1, 0, 0))

    def joined(parts):
        return _Sums(*[np.concatenate(c) for c in zip(*parts)]).added(np.zeros(len(parts), int), 1)

    whole = _Sums(*state(np.arange(300)))
    parts = [state(np.arange(a, b)) for a, b in ((0, 7), (7, 200), (200, 300))]
    for order in (parts, parts[::-1]):
        got = joined(order)
        assert got.n[0] == 300 and got.centre == pytest.approx(whole.centre)
        assert got.gram == pytest.approx(whole.gram, abs=1e-8) and got.rhs == pytest.approx(whole.rhs, abs=1e-8)


def test_incomplete_rows_many_groups_and_empty_tables(spark):
    rows = [(k % 1500, float(k), None if k % 7 == 0 else 2.0 * k + k % 1500) for k in range(9000)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(rows, "grp int, x double, y double").repartition(3)
    fits = {r["grp"]: r for r in least_squares(df, ["x"], "y", by=["grp"]).collect()}
    assert len(fits) == 1501 and fits[9999]["status"] == "singular" and fits[9999]["n"] == 0
    assert all(f["theta"] == pytest.approx([g, 2.0], abs=1e-6) for g, f in fits.items() if g != 9999)
    assert least_squares(df.limit(0), ["x"], "y", by=["grp"]).count() == 0
    assert centred_moments(df, ["x"], ["y"], cross=True).first()["n"] == sum(r[2] is not None and r[1] is not None for r in rows)


def test_nulls_are_no_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (None, 1.0), (None, 1.0), (float("nan"), 1.0)], "v double, w double")
    assert iterate.weighted_quantile(df, "v", 0.5).first()["quantile"] == 2.0
    assert iterate.weighted_quantile(df, "v", 0.5, "w").first()["quantile"] == 2.0
    share = spark.createDataFrame([(0.1,), (0.95,), (None,), (float("nan"),)], "v double")
    assert {r["bin"]: r["n"] for r in ranks.density_histogram(share, "v", 10).collect()} == {1: 1, 9: 1}
