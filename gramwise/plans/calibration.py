"""Predictive intervals from load to report: one run, and the summary over datasets, methods and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gramwise.operators.encode import standardise
from gramwise.operators.intervals import coverage_rows, gaussian_quantiles, interval_summary, scored_rows
from gramwise.operators.metrics import coverage, curve, group_means, mean_width, wide_table
from gramwise.operators.moments import least_squares, linear_score
from gramwise.operators.ranks import density_histogram, uniform_ks
from gramwise.operators.sampling import cap_rows, train_test_split
from gramwise.session import stored


def capped_split(df: DataFrame, key: str, xs: Sequence[str], y: str, cap: int | None, test_fraction: float, seed: int) -> DataFrame:
    """All rows, or ``cap`` of them if given, split, with covariates and response scaled by the training rows."""
    rows = df.select(key, *xs, y)
    rows = rows if cap is None else cap_rows(rows, key, cap, seed)
    split = train_test_split(rows, key, test_fraction=test_fraction, seed=seed + 1)
    return standardise(split, [*xs, y], F.col("split") == "train")


def linear_gaussian_quantiles(rows: DataFrame, xs: Sequence[str], y: str, levels: Sequence[float], noise: float = 0.0, name: str = "q") -> DataFrame:
    """Test rows with normal predictive quantiles around a least-squares fit of the training rows."""
    train = rows.where(F.col("split") == "train")
    theta = least_squares(train, xs, y).first()["theta"]
    gap = F.col(y) - linear_score(theta, xs)
    variance = train.agg(F.avg(gap * gap)).first()[0]
    test = rows.where(F.col("split") == "test")
    return test.withColumn(name, gaussian_quantiles(linear_score(theta, xs), F.lit(variance), noise, levels))


def run_one(df: DataFrame, key: str, xs: Sequence[str], y: str, levels: Sequence[float], cap: int | None = None, test_fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """One row of interval scores for one table and seed."""
    rows = capped_split(df, key, xs, y, cap, test_fraction, seed)
    return interval_summary(linear_gaussian_quantiles(rows, xs, y, levels), y, "q", levels)


def _per_seed(df: DataFrame, y: str, q: str, levels, dataset: str, method: str, seed: str) -> DataFrame:
    return interval_summary(df, y, q, levels, [dataset, method, seed])


def dataset_summary(df: DataFrame, y: str, q: str, levels: Sequence[float], dataset: str, method: str, seed: str) -> DataFrame:
    """Per dataset and method: coverage at 95%, width, CRPS (means over seeds) and the KS distance of the PIT, 3 digits."""
    low, high = (F.get(q, list(levels).index(a)) for a in (0.025, 0.975))
    scored = scored_rows(df, y, q, levels).select(dataset, method, seed, "pit", "crps", F.col(y).alias("__y"), low.alias("__low"), high.alias("__high"))
    # scored once, read by the means and by both passes of the distances
    scored = stored(scored, "scored")
    per_seed = scored.groupBy(dataset, method, seed).agg(coverage("__y", "__low", "__high").alias("cov_95"), mean_width("__low", "__high").alias("width_95"), F.avg("crps").alias("crps"))
    means = group_means(per_seed, [dataset, method], ["cov_95", "width_95", "crps"])
    ks = uniform_ks(scored, "pit", [dataset, method]).select(dataset, method, "ks")
    joined = means.join(ks, [dataset, method])
    return joined.select(dataset, method, *[F.round(c, 3).alias(c) for c in ("cov_95", "width_95", "crps", "ks")])


def overall_summary(summary: DataFrame, method: str) -> DataFrame:
    """Per method the mean of the rounded dataset values."""
    return group_means(summary, [method], ["cov_95", "width_95", "crps", "ks"])


def calibration_curve(df: DataFrame, y: str, q: str, levels: Sequence[float], dataset: str, method: str, seed: str) -> DataFrame:
    """(method, level, mean, sd) of coverage over datasets and seeds."""
    per_level = coverage_rows(_per_seed(df, y, q, levels, dataset, method, seed), [dataset, method, seed])
    return curve(per_level, [method, "level"], "coverage")


def pit_histogram(df: DataFrame, y: str, q: str, levels: Sequence[float], method: str, bins: int = 20) -> DataFrame:
    return density_histogram(scored_rows(df, y, q, levels), "pit", bins, [method])


def width_table(summary: DataFrame, dataset: str, method: str, methods: Sequence[str]) -> DataFrame:
    """Dataset x method mean widths."""
    return wide_table(summary, dataset, method, methods, "width_95")
