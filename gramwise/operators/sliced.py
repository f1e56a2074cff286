"""Semi-supervised estimation through sliced inverse regression and kernel smoothing.

Per fold: whiten the covariates, cut the response into slices, hand every unlabelled row the slice of its nearest
labelled row, take the leading directions of the slice means, smooth the response along them, and blend the
resulting fit with least squares.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.operators.metrics import slice_table
from gramwise.operators.centred import centred_moments
from gramwise.operators.moments import collect_moments, least_squares, linear_score, moments, symmetric
from gramwise.operators.neighbors import kernel_smooth, nearest_join
from gramwise.session import settle


def whitening(df: DataFrame, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance^-1/2) from one moment pass."""
    row = centred_moments(df, xs).first()
    n, gram = row["n"], symmetric(row["g"])
    off = gram[0, 1:] / n
    mean = np.asarray(row["centre"]) + off
    cov = (gram[1:, 1:] - n * np.outer(off, off)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    return mean, vectors @ np.diag(1.0 / np.sqrt(values)) @ vectors.T


def linear_map(xs: Sequence[str], matrix: np.ndarray, shift: np.ndarray | None = None) -> Column:
    """Array column of matrix' (x - shift), one entry per matrix column."""
    shift = np.zeros(len(xs)) if shift is None else shift
    return F.array(*[
        linear_score([-float(shift @ matrix[:, j]), *matrix[:, j]], xs) for j in range(matrix.shape[1])
    ])


def slice_of(y: str, width: float) -> Column:
    return (F.floor(F.col(y) / F.lit(width)) + 1).cast("long")


def inverse_regression_directions(
    df: DataFrame, key: str, xs: Sequence[str], y: str, labelled: str, slices: int, directions: int, slice_weights: str = "share"
) -> np.ndarray:
    """p x r directions from slice means of whitened covariates over labelled and unlabelled rows."""
    mean, root = whitening(df, xs)
    span = df.where(F.col(labelled)).agg(F.min(y), F.max(y)).first()
    width = (span[1] - span[0]) / slices
    white = df.withColumn("__v", linear_map(xs, root, mean))
    on = white.where(F.col(labelled)).withColumn("__slice", slice_of(y, width))
    off = white.where(~F.col(labelled))
    near = nearest_join(off, on, 1, key, key, "__v", F.col("__slice"))
    moved = near.select(F.col("qid").alias(key), F.get(F.col("neighbours"), 0)["payload"].cast("long").alias("__slice"))
    all_rows = on.select("__slice", "__v").unionByName(off.join(moved, key).select("__slice", "__v"))
    columns = [f"v{j}" for j in range(len(xs))]
    flat = all_rows.select("__slice", *[F.get(F.col("__v"), j).alias(c) for j, c in enumerate(columns)])
    spread = np.zeros((len(xs), len(xs)))
    # The number of slices is a parameter, so this is a handful of rows.
    for r in slice_table(flat, "__slice", columns, slice_weights).collect():
        m = np.array([r[f"mean_{c}"] for c in columns])
        spread += r["share"] * np.outer(m, m)
    values, vectors = np.linalg.eigh(spread)
    top = vectors[:, np.argsort(values)[::-1][:directions]]
    signs = np.sign(top[np.abs(top).argmax(axis=0), range(top.shape[1])])
    return root @ (top * signs)


def bandwidth_errors(
    labelled: DataFrame, key: str, features: str | Column, y: str, fold: str, grid: Sequence[float], order: int
) -> DataFrame:
    """(h, error): held-out squared error of the smoother for every bandwidth, all from one distance pass."""
    smooth = kernel_smooth(labelled, labelled, key, key, features, y, [h**order for h in grid], mask=fold)
    joined = smooth.join(labelled.select(F.col(key).alias("qid"), F.col(y).alias("__y")), "qid")
    errors = joined.agg(
        F.array(*[F.sum(F.pow(F.col("__y") - F.get(F.col("smooth"), i), F.lit(2.0))) for i in range(len(grid))]).alias("e")
    )
    grid_column = F.array(*[F.lit(float(h)) for h in grid])
    cells = F.transform(F.col("e"), lambda e, i: F.struct(F.get(grid_column, i).alias("h"), e.alias("error")))
    return errors.select(F.explode(cells).alias("c")).select("c.*")


def best_bandwidth(labelled: DataFrame, key: str, features, y: str, fold: str, grid: Sequence[float], order: int) -> float:
    table = bandwidth_errors(labelled, key, features, y, fold, grid, order)
    return table.agg(F.min_by("h", F.struct("error", "h"))).first()[0]


DEFAULT_GRID = tuple(round(0.1 + 0.19 * i, 2) for i in range(11))
"""Bandwidths from 0.1 to 2.0."""


def sliced_semisupervised(
    df: DataFrame,
    key: str,
    xs: Sequence[str],
    y: str,
    labelled: str,
    fold: str,
    folds: int,
    slices: int = 5,
    directions: int = 1,
    grid: Sequence[float] = DEFAULT_GRID,
    slice_weights: str = "share",
) -> dict[str, np.ndarray]:
    """{'supervised', 'smoothed', 'blended'} coefficient vectors.

    ``fold`` numbers the labelled rows 0..folds-1. The blend moves each coefficient from least squares towards the
    smoothed fit by the share that reduces its variance.
    """
    p = len(xs)
    on, off = df.where(F.col(labelled)), df.where(~F.col(labelled))
    held, means = None, None
    for k in range(folds):
        train = on.where(F.col(fold) != k)
        both = train.unionByName(off)
        axes = inverse_regression_directions(both, key, xs, y, labelled, slices, directions, slice_weights)
        lined = lambda t: t.withColumn("__d", linear_map(xs, axes))
        inner = lined(train)
        h = best_bandwidth(inner, key, "__d", y, fold, grid, directions)
        widths = [h**directions]
        first = lambda s, name: s.select(F.col("qid").alias(key), F.get(F.col("smooth"), 0).alias(name))
        here = first(kernel_smooth(lined(on.where(F.col(fold) == k)), inner, key, key, "__d", y, widths), "__s")
        there = first(kernel_smooth(lined(off), inner, key, key, "__d", y, widths), f"__s{k}")
        held = here if held is None else held.unionByName(here)
        means = there if means is None else means.join(there, key)
    smoothed_on = settle(on.join(held, key))
    smoothed_off = off.join(means, key).withColumn(
        "__s", sum((F.col(f"__s{k}") for k in range(1, folds)), F.col("__s0")) / F.lit(float(folds))
    )
    # Linear correction of the smoother, on all labelled rows and off each fold.
    gap = F.col(y) - F.col("__s")
    eta = least_squares(smoothed_on, xs, gap).first()["theta"]
    supervised = np.array(least_squares(on, xs, y).first()["theta"])
    target = smoothed_off.withColumn("__mu", F.col("__s") + linear_score(eta, xs))
    smoothed = np.array(least_squares(target, xs, "__mu").first()["theta"])

    every = collect_moments(moments(df, xs))
    inverse = np.linalg.inv(every["gram"] / every["n"])
    etas = {
        k: least_squares(smoothed_on.where(F.col(fold) != k), xs, gap).first()["theta"] for k in range(folds)
    }
    correction = F.coalesce(*[F.when(F.col(fold) == k, linear_score(etas[k], xs)) for k in range(folds)])
    # phi = residual * (1, x) Gamma^-1 for the smoothed and for the supervised prediction.
    rows = smoothed_on.select(
        *xs,
        (gap - correction).alias("__rk"),
        (F.col(y) - linear_score(supervised, xs)).alias("__r0"),
    )
    forms = [linear_score(inverse[:, j], xs) for j in range(p + 1)]
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("__r0") * f * (F.col("__rk") - F.col("__r0")) * f).alias(f"c{j}") for j, f in enumerate(forms)],
        *[F.avg(F.pow((F.col("__rk") - F.col("__r0")) * f, F.lit(2.0))).alias(f"v{j}") for j, f in enumerate(forms)],
    ).first()
    slack = stats["n"] ** (-3.0 / 8.0)
    share = np.array([-stats[f"c{j}"] / (stats[f"v{j}"] + slack) for j in range(p + 1)])
    return {"supervised": supervised, "smoothed": smoothed, "blended": supervised + share * (smoothed - supervised)}
