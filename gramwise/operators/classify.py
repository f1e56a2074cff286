"""Classifiers: linear discriminant and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.operators.centred import centred_moments
from gramwise.operators.moments import linear_score, symmetric
from gramwise.operators.neighbors import nearest_join, vote


@dataclass(frozen=True)
class Discriminant:
    """Linear score per class: intercept and weights."""

    classes: list[int]
    forms: np.ndarray
    xs: list

    def predicted(self) -> Column:
        """The class with the largest score; the smallest label wins ties."""
        cells = [
            F.struct(linear_score(self.forms[i], self.xs).alias("s"), F.lit(-c).alias("c")) for i, c in enumerate(self.classes)
        ]
        return -F.array_max(F.array(*cells))["c"]

    def probability(self) -> Column:
        """P(last class | x) of a two-class fit."""
        gap = linear_score(self.forms[1] - self.forms[0], self.xs)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-gap))


def linear_discriminant(df: DataFrame, xs: Sequence[str | Column], label: str) -> Discriminant:
    """Class shares, class means and the pooled within-class covariance from one grouped pass."""
    rows = sorted(centred_moments(df, xs, by=[label]).collect(), key=lambda r: r[label])
    total = sum(r["n"] for r in rows)
    means, within = [], 0.0
    for r in rows:
        gram = symmetric(r["g"])
        # sums are about the class mean already, up to rounding
        off = gram[0, 1:] / r["n"]
        means.append(np.asarray(r["centre"]) + off)
        within = within + gram[1:, 1:] - r["n"] * np.outer(off, off)
    precision = np.linalg.pinv(within / (total - len(rows)))
    forms = np.array([
        np.concatenate([[np.log(r["n"] / total) - 0.5 * m @ precision @ m], precision @ m]) for r, m in zip(rows, means, strict=True)
    ])
    return Discriminant([int(r[label]) for r in rows], forms, list(xs))


# Smallest and largest neighbour counts as powers of the sample size.
K_LOW_POWER, K_HIGH_POWER, K_POINTS = 0.25, 0.75, 10


def neighbour_grid(n: int, points: int = K_POINTS) -> list[int]:
    """Neighbour counts from n^1/4 to n^3/4, equally spaced and rounded down."""
    return [int(v + 1e-9) for v in np.linspace(n**K_LOW_POWER, n**K_HIGH_POWER, points)]


def neighbour_predictions(
    train: DataFrame, test: DataFrame, key: str, features: str | Column, label: str, ks: Sequence[int], classes: Sequence[int], **scan
) -> DataFrame:
    """(qid, k, predicted) for every k of the grid from one distance pass."""
    near = nearest_join(test, train, max(ks), key, key, features, label, **scan)
    cells = [F.struct(F.lit(k).alias("k"), vote("neighbours", k, classes).alias("predicted")) for k in ks]
    return near.select("qid", F.explode(F.array(*cells)).alias("c")).select("qid", "c.*")


def neighbour_cv(
    train: DataFrame, key: str, features: str | Column, label: str, fold: str, ks: Sequence[int], classes: Sequence[int], **scan
) -> DataFrame:
    """(k, accuracy): mean over folds of held-out accuracy; each row's neighbours come from the other folds."""
    near = nearest_join(train, train, max(ks), key, key, features, label, mask=fold, **scan)
    cells = [F.struct(F.lit(k).alias("k"), vote("neighbours", k, classes).alias("predicted")) for k in ks]
    votes = near.select("qid", F.explode(F.array(*cells)).alias("c")).select("qid", "c.*")
    rows = votes.join(train.select(F.col(key).alias("qid"), F.col(label).alias("truth"), fold), "qid")
    per_fold = rows.groupBy("k", fold).agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("a"))
    return per_fold.groupBy("k").agg(F.avg("a").alias("accuracy"))


def choose_k(cv: DataFrame) -> int:
    """The most accurate k, the smallest on ties."""
    return cv.agg(F.max_by("k", F.struct(F.round("accuracy", 12), -F.col("k")))).first()[0]
