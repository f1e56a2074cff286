"""Comparison of semi-supervised estimators over random labelled samples of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from gramwise.functions.scalars import logistic
from gramwise.operators.iterate import logistic_regression
from gramwise.operators.metrics import term_errors
from gramwise.operators.moments import coefficient_rows, least_squares, linear_score, score_with
from gramwise.operators.ranks import attach
from gramwise.operators.sampling import labelled_size, seed_samples
from gramwise.operators.semisup import debiased_linear, debiased_logistic, grouped_calibrated_fit, grouped_calibration
from gramwise.session import settle


def _kept(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The columns in use, kept for the handful of passes that follow: one row per unit, not per seed."""
    return df.select(key, *dict.fromkeys(columns)).persist(StorageLevel.MEMORY_AND_DISK)


def coefficients_by_seed(
    df: DataFrame, key: str, xs: Sequence[str], y: str, imputer_xs: Sequence[str], seeds: Sequence[int], percent: float, cap: int | None = None
) -> DataFrame:
    """(seed, method, theta, status) of the supervised, imputed, debiased and calibrated fits.

    The seed is a grouping column: every fit of every seed comes from the same grouped passes. The imputer is
    least squares on ``imputer_xs`` over the labelled rows of the seed.
    """
    kept = _kept(df, key, [*xs, *imputer_xs, y])
    try:
        rows = seed_samples(kept, key, labelled_size(kept.count(), percent, cap), seeds)
        imputer = least_squares(rows.where("is_labelled"), imputer_xs, y, by=["seed"])
        imputed = score_with(rows, imputer, imputer_xs, "imputed", ["seed"])
        three = debiased_linear(imputed, xs, y, "imputed", "is_labelled", ["seed"])
        fourth = grouped_calibrated_fit(rows, xs, y, "is_labelled", ["seed"]).withColumn("method", F.lit("calibrated"))
        return settle(three.unionByName(fourth))
    finally:
        kept.unpersist()


def logistic_coefficients_by_seed(
    df: DataFrame, key: str, xs: Sequence[str], y: str, imputer_xs: Sequence[str], seeds: Sequence[int], percent: float, cap: int | None = None
) -> DataFrame:
    """The same for a 0/1 response: class probabilities are imputed and enter as fractional labels."""
    kept = _kept(df, key, [*xs, *imputer_xs, y])
    try:
        rows = seed_samples(kept, key, labelled_size(kept.count(), percent, cap), seeds)
        on = rows.where("is_labelled")
        imputer = logistic_regression(on, imputer_xs, y, by=["seed"])
        imputed = score_with(rows, imputer, imputer_xs, "eta", ["seed"]).withColumn("p1", logistic("eta"))
        three = debiased_logistic(imputed, xs, y, "p1", "is_labelled", ["seed"])
        forms = grouped_calibration(rows, xs, "is_labelled", ["seed"]).select("seed", "form")
        weighted = attach(on, forms, ["seed"]).withColumn("w", linear_score(F.col("form"), xs))
        fourth = logistic_regression(weighted, xs, y, "w", ["seed"], start="linear").select(
            "seed", F.lit("calibrated").alias("method"), "theta", "status"
        )
        return settle(three.unionByName(fourth))
    finally:
        kept.unpersist()


def compare(df: DataFrame, key: str, xs, y, imputer_xs, seeds, percent: float, cap: int | None = None, loss: str = "linear") -> DataFrame:
    """(method, term, mse, fits): mean squared error against the full-data fit, over the seeds that could be fitted."""
    if loss not in ("linear", "logistic"):
        raise ValueError(f"unknown loss {loss!r}: linear or logistic")
    if loss == "linear":
        fits, full = coefficients_by_seed(df, key, xs, y, imputer_xs, seeds, percent, cap), least_squares(df, xs, y)
    else:
        fits = logistic_coefficients_by_seed(df, key, xs, y, imputer_xs, seeds, percent, cap)
        full = logistic_regression(df, xs, y)
    truth = coefficient_rows(full, xs).select("term", "theta")
    errors = term_errors(coefficient_rows(fits.where(F.col("status") == "ok"), xs), truth)
    return errors.groupBy("method", "term").agg(F.avg("sq_error").alias("mse"), F.count(F.lit(1)).alias("fits"))


def status_counts(fits: DataFrame) -> DataFrame:
    """Fits per method and status, so that failed fits are visible rather than missing."""
    return fits.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))
