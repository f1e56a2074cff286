"""Regression with few labels: calibration weights, imputation, debiasing and their standard errors.

Tables hold labelled and unlabelled rows together; a boolean column says which is which. Statistics of both
sides come from one grouped pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.scalars import finite_or, logistic
from gramwise.operators.encode import polynomial_columns
from gramwise.operators.iterate import (
    fit_frame,
    gradient_descent,
    logistic_regression,
    quantile_regression,
    score_vector,
)
from gramwise.operators.moments import (
    add_moments,
    collect_moments,
    least_squares,
    linear_score,
    moments,
    solve_small,
    solved,
    symmetric,
)
from gramwise.operators.ranks import attach
from gramwise.session import settle


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Calibration:
    """Weights c1 + (1 - c1) mean_U(Z)' G_L^-1 Z as a linear form in the basis Z."""

    n: int
    n_unlabelled: int
    c1: float
    order: int
    coefficients: np.ndarray
    terms: list[Column]

    @property
    def weight(self) -> Column:
        return linear_score(self.coefficients, self.terms)


def calibration(
    df: DataFrame, xs: Sequence[str], labelled: str, order: int = 1, c1: float | None = None, ridge: float = 0.0
) -> Calibration:
    """Calibration of the labelled rows to the basis means of all rows; one aggregate over both sides.

    Over the labelled rows the weights average 1 and reproduce c1 * mean_L(Z) + (1 - c1) * mean_U(Z).
    ``ridge`` guards the solve (1e-6 is the customary value on real tables).
    """
    terms = polynomial_columns(xs, order, intercept=False)
    sides = {r["l"]: r for r in moments(df.withColumn("l", _c(labelled)), terms, by=["l"]).collect()}
    if True not in sides or False not in sides:
        raise ValueError("both labelled and unlabelled rows are needed")
    n, n_u = sides[True]["n"], sides[False]["n"]
    gram = symmetric(sides[True]["g"]) / n
    mean_u = symmetric(sides[False]["g"])[0] / n_u
    c1 = n / (n + n_u) if c1 is None else c1
    a = solve_small(gram, mean_u, ridge)
    if a is None:
        raise ValueError("the basis is singular on the labelled rows")
    coefficients = (1.0 - c1) * a
    coefficients[0] += c1
    return Calibration(n, n_u, c1, order, coefficients, terms)


def grouped_calibration(df: DataFrame, xs: Sequence[str], labelled: str, by: Sequence[str], order: int = 1) -> DataFrame:
    """(by..., n, n_unlabelled, form): the weight's linear form per group, solved on executors; null when singular."""
    by = list(by)
    terms = polynomial_columns(xs, order, intercept=False)
    sides = moments(df.withColumn("__l", _c(labelled)), terms, by=[*by, "__l"])
    pick = lambda on, c, n: F.first(F.when(F.col("__l") == on, F.col(c)), ignorenulls=True).alias(n)
    wide = sides.groupBy(*by).agg(pick(True, "g", "gl"), pick(True, "n", "n"), pick(False, "g", "gu"), pick(False, "n", "n_unlabelled"))

    @F.pandas_udf("array<double>")
    def form(gl: pd.Series, n: pd.Series, gu: pd.Series, m: pd.Series) -> pd.Series:
        def one(a, k, b, l):
            if a is None or b is None:
                return None
            c1 = k / (k + l)
            fit = solve_small(symmetric(a) / k, symmetric(b)[0] / l)
            if fit is None:
                return None
            fit = (1.0 - c1) * fit
            fit[0] += c1
            return fit.tolist()

        return pd.Series([one(*v) for v in zip(gl, n, gu, m, strict=True)])

    return wide.select(*by, "n", "n_unlabelled", form("gl", "n", "gu", "n_unlabelled").alias("form"))


def grouped_calibrated_fit(df: DataFrame, xs: Sequence[str], y: str, labelled: str, by: Sequence[str], order: int = 1) -> DataFrame:
    """(by..., theta, status): the linear calibrated fit of every group."""
    by = list(by)
    table = settle(grouped_calibration(df, xs, labelled, by, order).select(*by, F.col("form").alias("__form")))
    terms = polynomial_columns(xs, order, intercept=False)
    rows = attach(df.where(_c(labelled)), table, by).withColumn("__w", linear_score(F.col("__form"), terms))
    return least_squares(rows, xs, y, "__w", by).select(*by, "theta", "status")


def calibrated_fit(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    labelled: str,
    order: int = 1,
    loss: str = "linear",
    tau: float = 0.5,
    c1: float | None = None,
    ridge: float = 0.0,
    rate: float = 1e-3,
) -> tuple[DataFrame, Calibration]:
    """Projection-based semi-supervised fit: the labelled rows, refitted under the calibration weights."""
    cal = calibration(df, xs, labelled, order, c1, ridge)
    rows = df.where(_c(labelled))
    if loss == "linear":
        return least_squares(rows, xs, y, cal.weight, ridge=ridge).select("theta", "status"), cal
    if loss == "logistic":
        fit = logistic_regression(rows, xs, y, cal.weight, start="linear", tol=1e-5)
        return fit.select("theta", "status"), cal
    if loss == "quantile":
        # Negative weights are left out of the first fit and enter the refinement with their sign.
        theta, status = quantile_regression(rows, xs, y, tau, F.greatest(cal.weight, F.lit(0.0)))
        if rows.where(cal.weight < 0).limit(1).count():
            theta, _, refined = gradient_descent(rows, xs, y, theta, rate, "quantile", cal.weight, tau, max_iter=100)
            status = _worst(status, refined)
        return fit_frame(df.sparkSession, theta, status), cal
    raise ValueError(f"unknown loss {loss!r}")


# ---------------------------------------------------------------------------------------------------------
# Imputation and debiasing


def _variant_rows(labelled: Column, observed: str, imputed: str, train: str, every: str) -> Column:
    on_labelled = [(observed, "y"), ("imputed", "y"), (train, "h"), (every, "h")]
    on_unlabelled = [("imputed", "h"), (every, "h")]
    cell = lambda v, r: F.struct(F.lit(v).alias("variant"), F.lit(r).alias("uses"))
    return F.when(labelled, F.array(*[cell(v, r) for v, r in on_labelled])).otherwise(
        F.array(*[cell(v, r) for v, r in on_unlabelled])
    )


def debiased_linear(
    df: DataFrame, xs: Sequence[str | Column], y: str, imputed: str, labelled: str, by: Sequence[str] = (), ridge: float = 0.0
) -> DataFrame:
    """(by..., method, theta, status) for supervised, imputed and debiased least squares.

    One pass gives the moments of labelled and unlabelled rows with both responses; every fit is a sum of
    those few rows. debiased = all-imputed - (train-imputed - supervised).
    """
    by = list(by)
    flagged = df.withColumn("__l", _c(labelled)).withColumn("__y", F.when(F.col("__l"), _c(y).cast("double")).otherwise(0.0))
    sides = moments(flagged, xs, ["__y", imputed], by=[*by, "__l"])
    k = len(xs) + 1
    unfolded = sides.withColumn("v", F.explode(_variant_rows(F.col("__l"), "supervised", "imputed", "train", "all"))).select(
        *by,
        F.col("v.variant").alias("variant"),
        "n",
        "g",
        F.when(F.col("v.uses") == "y", F.slice("b", 1, k)).otherwise(F.slice("b", k + 1, k)).alias("b"),
        "rr",
    )
    fits = solved(add_moments(unfolded, [*by, "variant"]), ridge)
    return _combine_variants(fits, by)


def _combine_variants(fits: DataFrame, by: list[str]) -> DataFrame:
    pick = lambda v: F.first(F.when(F.col("variant") == v, F.col("theta")), ignorenulls=True).alias(f"t_{v}")
    wide = fits.groupBy(*by).agg(*[pick(v) for v in ("supervised", "imputed", "train", "all")])
    gap = F.zip_with("t_all", "t_train", lambda a, b: a - b)
    cells = F.array(
        F.struct(F.lit("supervised").alias("method"), F.col("t_supervised").alias("theta")),
        F.struct(F.lit("imputed").alias("method"), F.col("t_imputed").alias("theta")),
        F.struct(F.lit("debiased").alias("method"), F.zip_with("t_supervised", gap, lambda a, b: a + b).alias("theta")),
    )
    out = wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    return out.withColumn("status", F.when(F.col("theta").isNull(), "singular").otherwise("ok"))


def debiased_logistic(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    p1: str,
    labelled: str,
    by: Sequence[str] = (),
    mode: str = "fractional",
) -> DataFrame:
    """The same three fits for a 0/1 response with imputed class probabilities ``p1``.

    'fractional' enters an imputed row once per class, weighted by its probability; 'hard' by its likelier class.
    The four Newton fits run together, grouped by variant.
    """
    if mode not in ("fractional", "hard"):
        raise ValueError(f"unknown mode {mode!r}")
    by = list(by)
    p = F.col(p1).cast("double") if mode == "fractional" else (F.col(p1) >= 0.5).cast("double")
    # A weighted 0/1 pair has the same likelihood as one row whose response is the probability.
    rows = df.withColumn("__v", F.explode(_variant_rows(_c(labelled), "supervised", "imputed", "train", "all"))).select(
        *by,
        *[F.col(x) for x in xs],
        F.col("__v.variant").alias("variant"),
        F.when(F.col("__v.uses") == "y", F.col(y).cast("double")).otherwise(p).alias("__target"),
    )
    fits = logistic_regression(rows, xs, "__target", by=[*by, "variant"])
    return _combine_variants(fits, by)


def _worst(*statuses: str) -> str:
    """The first status that is not ``ok``."""
    return next((s for s in statuses if s != "ok"), "ok")


def debiased_quantile(df: DataFrame, xs: Sequence[str], y: str, imputed: str, labelled: str, tau: float) -> DataFrame:
    """The three fits for linear quantile regression."""
    on = df.where(_c(labelled))
    mixed = df.withColumn("__m", F.when(_c(labelled), _c(y).cast("double")).otherwise(F.col(imputed)))
    sup, s0 = quantile_regression(on, xs, y, tau)
    mix, s1 = quantile_regression(mixed, xs, "__m", tau)
    train, s2 = quantile_regression(on, xs, imputed, tau)
    every, s3 = quantile_regression(df, xs, imputed, tau)
    rows = [("supervised", sup, s0), ("imputed", mix, s1), ("debiased", every - (train - sup), _worst(s0, s2, s3))]
    return df.sparkSession.createDataFrame(
        [(m, [float(v) for v in t], s) for m, t, s in rows], "method string, theta array<double>, status string"
    )


# ---------------------------------------------------------------------------------------------------------
# Standard errors and order selection


def _hessian(unlabelled: DataFrame, xs, theta, loss: str) -> np.ndarray:
    if loss == "linear":
        rows = moments(unlabelled, xs)
    else:
        p = logistic(linear_score(theta, xs))
        rows = moments(unlabelled.withColumn("__p", p), xs, weight=F.col("__p") * (1.0 - F.col("__p")))
    m = collect_moments(rows)
    return m["gram"] / m["n"]


def perturbed_hessian(
    df: DataFrame, xs: Sequence[str], y: str, theta: Sequence[float], tau: float, draws: int = 2000, seed: int = 0
) -> np.ndarray:
    """Derivative of the mean check-loss score at theta from random shifts of size n^-1/2, in one pass.

    Each task adds up the score at every shifted coefficient vector; a draws x (p+1) table is all that leaves it.
    """
    n = df.count()
    d = len(xs) + 1
    shifts = np.random.default_rng(seed).standard_normal((draws, d))
    at = np.asarray(theta)[None, :] + shifts / np.sqrt(n)

    def partial(batches):
        total = np.zeros((draws, d))
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            for start in range(0, len(v), 2000):
                x, target = v[start : start + 2000, :d], v[start : start + 2000, d]
                total += ((target[:, None] - x @ at.T <= 0.0) - tau).T @ x
        yield pd.DataFrame({"b": np.repeat(np.arange(draws), d), "j": np.tile(np.arange(d), draws), "s": total.ravel()})

    v = F.array(F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double"))
    sums = df.select(v.alias("v")).mapInPandas(partial, "b int, j int, s double").groupBy("b", "j").agg(F.sum("s").alias("s"))
    u = np.zeros((draws, d))
    for r in sums.collect():
        u[r["b"], r["j"]] = r["s"] / np.sqrt(n)
    hessian = np.linalg.lstsq(shifts, u, rcond=None)[0].T
    return (hessian + hessian.T) / 2.0 if np.linalg.cond(hessian) > 1e13 else hessian


def sandwich_errors(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    labelled: str,
    fold: str,
    theta: Sequence[float],
    order: int,
    loss: str = "linear",
    tau: float = 0.5,
    factor: float | None = None,
    ridge: float = 0.0,
    draws: int = 2000,
) -> np.ndarray:
    """Cross-fitted standard errors of a semi-supervised fit.

    The score is projected on the basis off-fold; what remains on the fold and what is explained on the
    unlabelled rows add up to the variance. Every matrix follows from one moment pass per side.
    ``factor`` multiplies the projection: 1 - c1 by default, 1 for density-ratio weighting.
    """
    terms = polynomial_columns(xs, order, intercept=False)
    on, off = df.where(_c(labelled)), df.where(~_c(labelled))
    scores = score_vector(y, linear_score(theta, xs), xs, loss, tau)
    d = len(scores)
    folds = [
        {"n": r["n"], "gram": symmetric(r["g"]), "rhs": np.asarray(r["b"]).reshape(d, -1), "cross": symmetric(r["rr"])}
        for r in moments(on, terms, scores, by=[fold], cross=True).collect()
    ]
    u_side = collect_moments(moments(off, terms))
    n, n_u = sum(f["n"] for f in folds), u_side["n"]
    factor = 1.0 - n / (n + n_u) if factor is None else factor
    gram, rhs = sum(f["gram"] for f in folds), sum(f["rhs"] for f in folds)
    w1 = np.zeros((d, d))
    for f in folds:
        a = factor * solve_small(gram - f["gram"], (rhs - f["rhs"]).T, ridge)
        w1 += f["cross"] - f["rhs"] @ a - a.T @ f["rhs"].T + a.T @ f["gram"] @ a
    a = factor * solve_small(gram, rhs.T, ridge)
    variance = w1 / n + (n / n_u) * (a.T @ u_side["gram"] @ a) / n_u
    if loss == "quantile":
        h = perturbed_hessian(on, xs, y, theta, tau, draws)
    else:
        h = _hessian(off, xs, theta, loss)
    inverse = np.linalg.inv(h)
    return np.sqrt(np.diag(inverse @ variance @ inverse.T) / n)


def _weighted_grams(df: DataFrame, z: list[Column], weights: list[Column], most: int = 300) -> list[np.ndarray]:
    """sum(w z z') for several weights; as many per pass as one aggregate should hold."""
    k = len(z)
    per = k * (k + 1) // 2
    chunk = max(1, most // per)
    out: list[np.ndarray] = []
    for start in range(0, len(weights), chunk):
        part = weights[start : start + chunk]
        named = df.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], *[w.alias(f"w{i}") for i, w in enumerate(part)])
        sums = [
            F.array(*[F.sum(F.col(f"w{m}") * F.col(f"z{i}") * F.col(f"z{j}")) for i in range(k) for j in range(i, k)]).alias(f"g{m}")
            for m in range(len(part))
        ]
        row = named.agg(*sums).first()
        out += [symmetric(row[f"g{m}"]) for m in range(len(part))]
    return out


SINGULAR_CRITERION = 9999999.0
"""Fixed value: the criterion of an order whose basis is singular."""


def order_criteria(df: DataFrame, xs: Sequence[str], scores: Sequence[Column], most: int) -> DataFrame:
    """(order, criterion) for polynomial orders 1..most; the smallest criterion wins.

    One pass serves the fits of every order (leading blocks of one Gram); residual-weighted Grams need one more.
    """
    p, d = len(xs), len(scores)
    named = df.select(*[F.col(x) for x in xs], *[s.alias(f"__s{i}") for i, s in enumerate(scores)])
    terms = polynomial_columns(xs, most, intercept=False)
    m = collect_moments(moments(named, terms, [f"__s{i}" for i in range(d)], cross=True), d)
    n = m["n"]
    values: dict[int, float] = {}
    fitted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for t in range(1, most + 1):
        k = 1 + p * t
        gram, rhs = m["gram"][:k, :k], m["rhs"][:, :k]
        coef = solve_small(gram, rhs.T)
        if coef is None:
            values[t] = SINGULAR_CRITERION
            continue
        rss = np.diag(m["cross"]) - np.einsum("kj,jk->j", coef, rhs)
        fitted[t] = (gram / n, coef, np.maximum(rss, 1e-300) / (n - p * t - 1))
    weights, owners = [], []
    for t, (_, coef, _) in fitted.items():
        for j in range(d):
            r = F.col(f"__s{j}") - linear_score(coef[:, j], terms[: p * t])
            weights.append(r * r)
            owners.append((t, j))
    grams = dict(zip(owners, _weighted_grams(named, [F.lit(1.0), *terms], weights), strict=True)) if weights else {}
    for t, (gram, _, sigma2) in fitted.items():
        k = 1 + p * t
        gain = 0.0
        for j in range(d):
            c = np.linalg.solve(gram, grams[(t, j)][:k, :k] / n) / sigma2[j]
            gain += float(np.trace(c)) - float(np.linalg.slogdet(c)[1])
        free = n - p * t - 1
        values[t] = (d * free + n * float(np.log(sigma2).sum()) + d * np.log(n) * p * t + gain) / n
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in sorted(values.items())], "`order` int, criterion double")


def choose_order(
    df: DataFrame, xs: Sequence[str], y: str, labelled: str, half: str, most: int = 3, loss: str = "linear", tau: float = 0.5
) -> tuple[int, DataFrame]:
    """Order with the smallest criterion; scores are cross-fitted on two halves (``half`` = 0 / 1)."""
    on = df.where(_c(labelled))
    thetas = {}
    for side in (0, 1):
        part = on.where(F.col(half) == side)
        if loss == "linear":
            thetas[side] = least_squares(part, xs, y).first()["theta"]
        elif loss == "logistic":
            thetas[side] = logistic_regression(part, xs, y).first()["theta"]
        else:
            thetas[side] = quantile_regression(part, xs, y, tau)[0]
    prediction = F.when(F.col(half) == 0, linear_score(thetas[1], xs)).otherwise(linear_score(thetas[0], xs))
    table = order_criteria(on, xs, score_vector(y, prediction, xs, loss, tau), most)
    best = table.agg(F.min_by("order", F.struct("criterion", "order"))).first()[0]
    return best, table


# ---------------------------------------------------------------------------------------------------------
# Other semi-supervised estimators


def partial_information(df: DataFrame, xs: Sequence[str], y: str, labelled: str) -> np.ndarray:
    """Linear coefficients from adjusted one-covariate regressions, residualised on labelled and unlabelled rows.

    One Gram over all rows gives every residualisation; the p adjusted regressions share one grouped pass.
    """
    p = len(xs)
    every = collect_moments(moments(df, xs))
    gram, total = every["gram"], every["n"]
    residual_forms, spread = [], []
    for j in range(1, p + 1):
        rest = [i for i in range(p + 1) if i != j]
        fit = solve_small(gram[np.ix_(rest, rest)], gram[rest, j])
        if fit is None:
            raise ValueError(f"{xs[j - 1]!r} cannot be residualised: the other covariates are collinear")
        form = np.zeros(p + 1)
        form[rest], form[j] = -fit, 1.0
        residual_forms.append(form)
        spread.append(float(form @ gram @ form) / total)
    on = df.where(_c(labelled)).select(F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double") for x in xs])
    cells = []
    for j in range(p):
        u = linear_score(residual_forms[j], xs) / F.lit(spread[j])
        adjusted = [F.col(x) * u - F.lit(1.0 if l == j else 0.0) for l, x in enumerate(xs)]
        cells.append(F.struct(F.lit(j).alias("j"), (F.col("__y") * u).alias("r"), u.alias("u"), *[a.alias(f"a{l}") for l, a in enumerate(adjusted)]))
    long = on.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    fits = least_squares(long, ["u", *[f"a{l}" for l in range(p)]], "r", by=["j"]).collect()
    if any(r["theta"] is None for r in fits):
        raise ValueError("an adjusted regression is singular on the labelled rows")
    beta = np.zeros(p)
    for r in fits:
        beta[r["j"]] = r["theta"][0]
    row = on.agg(F.avg("__y"), *[F.avg(x) for x in xs]).first()
    return np.concatenate([[row[0] - float(beta @ np.array(row[1:], dtype=float))], beta])


@dataclass(frozen=True)
class DensityRatio:
    """Weights exp(alpha'Z) that match labelled basis means to the unlabelled ones."""

    alpha: np.ndarray
    terms: list[Column]
    error: bool
    steps: int

    @property
    def weight(self) -> Column:
        return finite_or(F.exp(linear_score(self.alpha, self.terms)), 1.0, 1e-7)


def density_ratio(
    df: DataFrame, xs: Sequence[str], labelled: str, order: int = 1, tol: float = 1e-5, max_iter: int = 50
) -> DensityRatio:
    """Newton moment matching; one weighted aggregate over the labelled rows per step.

    A badly scaled system (a singular value above 99999 or below tol), or no convergence within ``max_iter`` steps,
    falls back to equal weights, ``error`` set.
    """
    terms = polynomial_columns(xs, order, intercept=False)
    names = [f"__t{i}" for i in range(len(terms))]
    on = df.where(_c(labelled)).select(*[t.alias(a) for t, a in zip(terms, names, strict=True)]).persist()
    target = collect_moments(moments(df.where(~_c(labelled)), terms))
    goal = target["gram"][0] / target["n"]
    alpha, steps = np.zeros(len(terms) + 1), 0
    try:
        for steps in range(1, max_iter + 1):
            weight = finite_or(F.exp(linear_score(alpha, names)), 1.0, 1e-7)
            m = collect_moments(moments(on.withColumn("__e", weight), names, weight="__e"))
            second = m["gram"] / m["n"]
            sizes = np.linalg.svd(second, compute_uv=False)
            if sizes.max() > 99999 or sizes.min() < tol:
                return DensityRatio(np.zeros(len(terms) + 1), terms, True, steps)
            step = -np.linalg.solve(second, second[0] - goal)
            alpha = alpha + step
            if np.linalg.norm(step) <= tol:
                return DensityRatio(alpha, terms, False, steps)
    finally:
        on.unpersist()
    return DensityRatio(np.zeros(len(terms) + 1), terms, True, steps)


def density_ratio_fit(
    df: DataFrame, xs: Sequence[str], y: str, labelled: str, order: int = 1, loss: str = "linear", tau: float = 0.5
) -> tuple[DataFrame, DensityRatio]:
    """Weighted linear, logistic or quantile fit under density-ratio weights.

    Where the weights fell back to equal ones, an otherwise good fit has the status ``equal weights``.
    """
    if loss not in ("linear", "logistic", "quantile"):
        raise ValueError(f"unknown loss {loss!r}")
    ratio = density_ratio(df, xs, labelled, order)
    rows = df.where(_c(labelled))
    if loss == "linear":
        fit = least_squares(rows, xs, y, ratio.weight).select("theta", "status")
    elif loss == "logistic":
        fit = logistic_regression(rows, xs, y, ratio.weight).select("theta", "status")
    else:
        theta, status = quantile_regression(rows, xs, y, tau, ratio.weight)
        fit = fit_frame(df.sparkSession, theta, status)
    if ratio.error:
        fit = fit.withColumn("status", F.when(F.col("status") == "ok", "equal weights").otherwise(F.col("status")))
    return fit, ratio

