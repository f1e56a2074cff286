"""Estimators that need several passes: Newton, gradient descent and smoothed quantile regression.

Only coefficients change between passes. One fit keeps them as literals; fits for many groups keep them in a
table that is checkpointed each round, and groups that have converged drop out of the next pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.scalars import check_score, linear_score as squared_score, logistic, logistic_score
from gramwise.operators.moments import (
    collect_moments,
    least_squares,
    linear_score,
    moments,
    solve_small,
    solved,
)
from gramwise.operators.digits import select_ranks
from gramwise.operators.ranks import attach, prefix
from gramwise.operators.vertex import exact_quantile_fit
from gramwise.session import BROADCAST_BYTES, settle


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def _slim(df: DataFrame, xs, y, weight, by) -> tuple[DataFrame, list[str]]:
    """Only the columns the passes read, kept across passes."""
    names = [f"__x{i}" for i in range(len(xs))]
    slim = df.select(
        *by,
        *[_c(x).cast("double").alias(n) for x, n in zip(xs, names, strict=True)],
        _c(y).cast("double").alias("__y"),
        (F.lit(1.0) if weight is None else _c(weight).cast("double")).alias("__w"),
    )
    return slim.persist(StorageLevel.MEMORY_AND_DISK), names


def _about_means(slim: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The kept columns minus their means, so that steps keep their digits far from zero; and the means."""
    known = lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))
    means = np.array([float(v or 0.0) for v in slim.agg(*[F.avg(known(n)) for n in names]).first()]) if names else np.zeros(0)
    return slim.withColumns({n: F.col(n) - F.lit(float(c)) for n, c in zip(names, means, strict=True)}), means


def _moved_back(theta: np.ndarray, means: np.ndarray, sign: float = -1.0) -> np.ndarray:
    """Coefficients for (1, x) from those for (1, x - means); ``sign`` = 1 goes the other way."""
    return np.concatenate(([theta[0] + sign * means @ theta[1:]], theta[1:]))


def logistic_regression(
    df: DataFrame,
    xs: Sequence[str | Column],
    y: str | Column,
    weight: str | Column | None = None,
    by: Sequence[str] = (),
    start: str = "zero",
    tol: float = 1e-8,
    max_iter: int = 50,
) -> DataFrame:
    """Unpenalised logistic fit by Newton steps: (by..., theta, status, iterations).

    Weights may be fractional or negative. ``start`` is 'zero' or 'linear' (the least-squares coefficients).
    """
    by = list(by)
    slim, names = _slim(df, xs, y, weight, by)
    try:
        if by:
            return _grouped_newton(slim, names, by, start, tol, max_iter)
        return _single_newton(df.sparkSession, slim, names, start, tol, max_iter)
    finally:
        slim.unpersist()


def _newton_moments(rows: DataFrame, names: list[str], eta: Column, by: list[str]) -> DataFrame:
    p = logistic(eta)
    rows = rows.withColumn("__p", p)
    curvature = F.col("__w") * F.col("__p") * (1.0 - F.col("__p"))
    return moments(rows, names, [F.col("__w") * (F.col("__y") - F.col("__p"))], curvature, by)


def _single_newton(spark, slim, names, start, tol, max_iter) -> DataFrame:
    theta = np.zeros(len(names) + 1)
    slim, means = _about_means(slim, names)
    if start == "linear":
        first = least_squares(slim, names, "__y", "__w").first()["theta"]
        theta = np.array(first) if first is not None else theta
    status, steps = "not converged", 0
    for steps in range(1, max_iter + 1):
        part = collect_moments(_newton_moments(slim, names, linear_score(theta, names), []), 1)
        step = solve_small(part["gram"], part["rhs"][0])
        if step is None:
            status = "singular"
            break
        theta = theta + step
        if not np.all(np.isfinite(theta)):
            status = "diverged"
            break
        if float(np.linalg.norm(step)) <= tol:
            status = "ok"
            break
    return spark.createDataFrame(
        [([float(v) for v in _moved_back(theta, means)], status, steps)], "theta array<double>, status string, iterations int"
    )


def _grouped_newton(slim, names, by, start, tol, max_iter) -> DataFrame:
    # every group is fitted about its own means; theta stays in those coordinates until the end
    zero = F.array(*[F.lit(0.0)] * (len(names) + 1))
    means = F.array(*[F.coalesce(F.avg(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))), F.lit(0.0)) for n in names])
    fits = slim.groupBy(*by).agg(means.alias("__means")).withColumn("theta", zero)
    product = lambda theta: F.aggregate(F.zip_with(F.slice(theta, 2, len(names)), "__means", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    moved_by = lambda theta, sign: F.concat(F.array(F.get(theta, 0) + F.lit(sign) * product(theta)), F.slice(theta, 2, len(names))) if names else F.col(theta)
    if start == "linear":
        first = least_squares(slim, names, "__y", "__w", by).select(*by, F.col("theta").alias("__first"))
        fits = attach(fits, first, by, "left")
        fits = fits.select(*by, "__means", F.coalesce(moved_by("__first", 1.0), "theta").alias("theta"))
    open_fits = settle(fits)
    remaining, finished = open_fits.count(), None
    for step_number in range(1, max_iter + 1):
        # The table of open fits is stored and counted, so its size is known before it is broadcast.
        small = remaining * (len(names) + len(by) + 8) * 16 <= BROADCAST_BYTES
        table = F.broadcast(open_fits) if small else open_fits
        rows = slim.join(table.withColumnRenamed("theta", "__theta"), by)
        rows = rows.withColumns({n: F.col(n) - F.get("__means", j) for j, n in enumerate(names)})
        sums = _newton_moments(rows, names, linear_score(F.col("__theta"), names), by)
        stepped = solved(sums).select(*by, F.col("theta").alias("__step"), "status")
        moved = (
            open_fits.join(stepped, by)
            .withColumn("__norm", F.sqrt(F.aggregate("__step", F.lit(0.0), lambda a, v: a + v * v)))
            .select(
                *by,
                "__means",
                F.when(F.col("__step").isNotNull(), F.zip_with("theta", "__step", lambda a, b: a + b))
                .otherwise(F.col("theta"))
                .alias("theta"),
                F.when(F.col("status") != "ok", F.col("status"))
                .when(F.isnan("__norm"), "diverged")
                .when(F.col("__norm") <= tol, "ok")
                .alias("status"),
            )
            .withColumn("iterations", F.lit(step_number))
        )
        moved = settle(moved)
        counts = {bool(r["done"]): r["count"] for r in moved.groupBy(F.col("status").isNotNull().alias("done")).count().collect()}
        if counts.get(True):
            closed = moved.where(F.col("status").isNotNull())
            finished = closed if finished is None else finished.unionByName(closed)
        remaining = counts.get(False, 0)
        open_fits = moved.where(F.col("status").isNull()).select(*by, "__means", "theta")
        if not remaining:
            break
    if remaining:
        rest = open_fits.withColumns({"status": F.lit("not converged"), "iterations": F.lit(max_iter)})
        finished = rest if finished is None else finished.unionByName(rest)
    return finished.select(*by, moved_by("theta", -1.0).alias("theta"), "status", "iterations")


def score_vector(y, prediction, xs: Sequence[str | Column], loss: str, tau: float = 0.5) -> list[Column]:
    """Gradient of the loss at each row: derivative in the linear predictor times (1, x)."""
    if loss == "linear":
        s = squared_score(y, prediction)
    elif loss == "logistic":
        s = logistic_score(y, prediction)
    elif loss == "quantile":
        s = check_score(y, prediction, tau)
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return [s, *[s * _c(x) for x in xs]]


def gradient_descent(
    df: DataFrame,
    xs: Sequence[str | Column],
    y: str | Column,
    start: Sequence[float],
    rate: float,
    loss: str,
    weight: str | Column | None = None,
    tau: float = 0.5,
    tol: float = 1e-5,
    max_iter: int = 50,
) -> tuple[np.ndarray, int, str]:
    """Weighted descent on the mean loss; at most ``max_iter`` steps, one aggregate each. Returns (theta, steps, status)."""
    slim, names = _slim(df, xs, y, weight, [])
    theta, steps, status = np.asarray(start, dtype=float), 0, "not converged"
    try:
        for steps in range(1, max_iter + 1):
            parts = score_vector("__y", linear_score(theta, names), names, loss, tau)
            row = slim.agg(*[F.avg(F.col("__w") * s).alias(f"s{i}") for i, s in enumerate(parts)]).first()
            step = -rate * np.array([float(v) for v in row])
            theta = theta + step
            if np.linalg.norm(step) <= tol:
                status = "ok"
                break
    finally:
        slim.unpersist()
    return theta, steps, status


def weighted_quantile(df: DataFrame, column: str, tau: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantile: the smallest value whose running weight reaches tau of the total. (by..., quantile)

    This is the intercept-only quantile regression. Rows whose value or weight is null or NaN take no part.
    """
    by = list(by)
    mass = F.sum(weight) if weight else F.count(F.lit(1))
    known = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    if weight:
        known = known & F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double"))
    distinct = df.where(known).groupBy(*by, F.col(column).alias("value")).agg(mass.cast("double").alias("n"))
    ranked = prefix(distinct, ["value"], "n", by)
    return ranked.where(F.col("through") >= F.col("total") * F.lit(tau) - 1e-9).groupBy(*by).agg(
        F.min("value").alias("quantile")
    )


def exact_median(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Median with the two middle values averaged: (by..., median)."""
    by = list(by)
    middle = lambda total: F.array(F.floor((total + 1) / 2), F.ceil((total + 1) / 2))
    return select_ranks(df, column, middle, by).groupBy(*by).agg((F.sum("value") / 2.0).alias("median"))


def quantile_regression(
    df: DataFrame,
    xs: Sequence[str | Column],
    y: str | Column,
    tau: float,
    weight: str | Column | None = None,
    start: Sequence[float] | None = None,
    shrink: float = 0.25,
    final_bandwidth: float = 1e-3,
    tol: float = 1e-5,
    max_iter: int = 100,
    exact: bool = True,
) -> tuple[np.ndarray, str]:
    """Linear quantile fit: Newton on the check loss convolved with a logistic kernel, its bandwidth shrinking, and from
    there the exact minimum of the check loss where all weights are positive (``exact``; see ``operators.vertex``).

    Bandwidths are relative to the residual deviation of the starting fit. Signed weights are accepted; a step
    that raises the smoothed loss is halved. Returns (theta, status).
    """
    kept, names = _slim(df, xs, y, weight, [])
    try:
        slim, means = _about_means(kept, names)
        positive = slim.withColumn("__p", F.greatest(F.col("__w"), F.lit(0.0)))
        base = collect_moments(moments(positive, names, [F.col("__p") * F.col("__y")], "__p"), 1)
        own_start = start is None
        if own_start:
            start = solve_small(base["gram"], base["rhs"][0])
            if start is None:
                return np.zeros(len(names) + 1), "singular"
        second = base["gram"] / max(base["gram"][0, 0], 1e-300)
        theta = np.asarray(start, dtype=float) if own_start else _moved_back(np.asarray(start, dtype=float), means, 1.0)
        residual = F.col("__y") - linear_score(theta, names)
        spread = slim.agg(F.stddev_pop(residual)).first()[0] or 1.0

        def look(at, h, h_next):
            """Loss at h; gradient, curvature and loss at h_next: one pass."""
            u = F.col("__y") - linear_score(at, names)
            rows = slim.withColumn("__u", u).withColumn("__s", logistic(-F.col("__u") / h_next))

            def loss(width):
                over = -F.col("__u") / width
                return F.col("__w") * (tau * F.col("__u") + width * (F.greatest(over, F.lit(0.0)) + F.log1p(F.exp(-F.abs(over)))))

            curvature = F.col("__w") * F.col("__s") * (1.0 - F.col("__s")) / h_next
            slope = F.col("__w") * (F.col("__s") - tau)
            # The losses ride along as responses: their sums against the intercept are the totals.
            part = collect_moments(moments(rows, names, [slope, loss(h_next), loss(h)], curvature), 3)
            return part["rhs"][2][0], (part["gram"], part["rhs"][0], part["rhs"][1][0])

        first = theta.copy()

        def ended(status: str) -> tuple[np.ndarray, str]:
            """Where the smoothed steps fail (few rows, for one), the exact descent still works from the first fit."""
            whole = slim.dropna()
            if exact and whole.where("__w <= 0").limit(1).count() == 0:
                found, reached = exact_quantile_fit(whole, names, "__y", "__w", tau, first, 4.0 * spread)
                if reached == "ok":
                    return _moved_back(found, means), reached
            return _moved_back(theta, means), status

        last = final_bandwidth * spread
        h = spread
        _, (gram, slope, loss) = look(theta, h, h)
        for _ in range(max_iter):
            step = solve_small(gram, -slope)
            if step is None:
                # Too few rows lie within the bandwidth: widen it and come back more slowly.
                if h >= spread:
                    return ended("singular")
                h, shrink = min(3.0 * h, spread), shrink**0.5
                _, (gram, slope, loss) = look(theta, h, h)
                continue
            # The bandwidth shrinks once the fitted values move by less than it.
            moved = float(np.sqrt(step @ second @ step))
            size, h_next = 1.0, max(h * shrink, last) if moved <= h else h
            while True:
                candidate = theta + size * step
                reached, new = look(candidate, h, h_next)
                if reached <= loss + 1e-12 * abs(loss) or size < 1e-3:
                    break
                size /= 2.0
            done = h <= last and size * moved <= tol * spread
            theta, h, (gram, slope, loss) = candidate, h_next, new
            if done:
                whole = slim.dropna()
                if exact and whole.where("__w <= 0").limit(1).count() == 0:
                    found, status = exact_quantile_fit(whole, names, "__y", "__w", tau, theta, 4.0 * last)
                    return (_moved_back(found, means), status) if status == "ok" else ended(status)
                return _moved_back(theta, means), "ok"
        return ended("not converged")
    finally:
        kept.unpersist()


def subgradient(df: DataFrame, xs, y, theta: Sequence[float], tau: float, weight=None) -> np.ndarray:
    """Mean of w (1{y <= x'theta} - tau)(1, x): near zero at a quantile solution."""
    w = F.lit(1.0) if weight is None else _c(weight)
    parts = score_vector(y, linear_score(theta, xs), xs, "quantile", tau)
    return np.array([float(v) for v in df.agg(*[F.avg(w * s).alias(f"s{i}") for i, s in enumerate(parts)]).first()])


def fit_frame(spark, theta: Sequence[float], status: str = "ok") -> DataFrame:
    """A driver-held coefficient vector in the shape of the other fits."""
    return spark.createDataFrame([([float(v) for v in theta], status)], "theta array<double>, status string")

