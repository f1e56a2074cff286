"""Scalar functions as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def logistic(z) -> Column:
    """1 / (1 + e^-z); large |z| saturates instead of overflowing."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def softplus(z) -> Column:
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(float(low))), F.lit(float(high)))


def at_least(x, floor: float) -> Column:
    return F.greatest(_c(x), F.lit(float(floor)))


def at_most_value(x, ceiling: float) -> Column:
    return F.least(_c(x), F.lit(float(ceiling)))


def step_function(x, cut: float = 0.0, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(_c(x) >= cut, F.lit(float(high))).otherwise(F.lit(float(low)))


def finite_or(x, when_nan: float, when_infinite: float) -> Column:
    """Replace NaN and infinities by stated values."""
    x = _c(x)
    return (
        F.when(F.isnan(x), F.lit(float(when_nan)))
        .when(F.abs(x) == F.lit(float("inf")), F.lit(float(when_infinite)))
        .otherwise(x)
    )


def to_class(p, cut: float = 0.5) -> Column:
    return (_c(p) >= F.lit(cut)).cast("int")


def gaussian_density(a) -> Column:
    a = _c(a)
    return F.exp(-a * a / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def normal_quantile(level: float, mu=0.0, sigma=1.0) -> Column:
    """mu + sigma * z(level); z is computed once while the plan is built."""
    return _c(mu) + _c(sigma) * F.lit(NormalDist().inv_cdf(level))


def band(mu, variance, noise: float = 0.0, z: float = 1.96) -> tuple[Column, Column]:
    """(lower, upper) = mu -/+ z * sqrt(variance + noise^2)."""
    half = F.lit(z) * F.sqrt(_c(variance) + F.lit(noise * noise))
    return _c(mu) - half, _c(mu) + half


def pinball(level, residual) -> Column:
    a, u = _c(level), _c(residual)
    return F.greatest(a * u, (a - 1.0) * u)


def linear_score(y, prediction) -> Column:
    """Derivative of the squared loss in the linear predictor."""
    return _c(prediction) - _c(y)


def logistic_score(y, eta) -> Column:
    return logistic(eta) - _c(y)


def check_score(y, prediction, tau: float) -> Column:
    return (_c(y) <= _c(prediction)).cast("double") - F.lit(float(tau))


def rbf_kernel(squared_distance, gamma: float) -> Column:
    return F.exp(F.lit(-gamma) * _c(squared_distance))


def min_kernel(x, z, n: float = 1.0) -> Column:
    return F.least(_c(x), _c(z)) / F.lit(float(n))


def dot(columns: Sequence[str | Column], weights: Sequence[float]) -> Column:
    """Sum of column * weight with literal weights."""
    total = F.lit(0.0)
    for column, weight in zip(columns, weights, strict=True):
        total = total + _c(column) * F.lit(float(weight))
    return total


def array_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a, b) -> Column:
    """Squared Euclidean distance of two array columns."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def inside(y, lower, upper) -> Column:
    """1.0 inside the closed interval, else 0.0."""
    return ((_c(lower) <= _c(y)) & (_c(y) <= _c(upper))).cast("double")


def same(a, b) -> Column:
    return (_c(a) == _c(b)).cast("double")


def half_even(x, digits: int = 0) -> Column:
    """Round half to even, as R and NumPy do."""
    return F.bround(_c(x), digits)


def utf8(column) -> Column:
    """Text of a binary column."""
    return F.decode(F.col(column) if isinstance(column, str) else column, "UTF-8")


def config_key(*parts) -> Column:
    return F.concat_ws("_", *[F.col(p) if isinstance(p, str) else p for p in parts])


def integer_grid(first: int, last: int, divisor: float = 1.0) -> Column:
    """(first, first+1, ..., last) / divisor; integer steps, so that no end point drifts."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: k / F.lit(float(divisor)))


def linspace(low: float, high: float, points: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda k: F.lit(float(low)) + k * F.lit(float(high) - float(low)) / F.lit(float(points - 1)),
    )


def geometric_grid(first: float, ratio: float, points: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(float(first)) * F.pow(F.lit(float(ratio)), k)
    )


def differences(a) -> Column:
    """x[i+1] - x[i] of an array column."""
    a = _c(a)
    size = F.size(a)
    return F.zip_with(F.slice(a, 2, size - 1), F.slice(a, 1, size - 1), lambda hi, lo: hi - lo)


def level_set(*groups: Sequence[float], digits: int = 3) -> Column:
    """Union of level lists, rounded, without duplicates, ascending."""
    arrays = [F.array(*[F.round(F.lit(float(v)), digits) for v in group]) for group in groups]
    return F.array_sort(F.array_distinct(F.concat(*arrays)))
