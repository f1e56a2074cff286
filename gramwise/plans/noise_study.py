"""Classifiers trained on flipped labels and judged on clean ones, for a grid of flip rates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.scalars import logistic
from gramwise.operators.encode import flip_labels
from gramwise.operators.iterate import logistic_regression
from gramwise.operators.metrics import accuracy
from gramwise.operators.moments import linear_score, moments, score_with, symmetric
from gramwise.operators.neighbors import nearest_join, vote
from gramwise.operators.ranks import attach
from gramwise.operators.sampling import kfold
from gramwise.session import settle


def noisy_rows(df: DataFrame, key: str, label: str, rates: Sequence[float], seed: int) -> DataFrame:
    """Every row once per flip rate ``rho``, with the flipped label ``noisy``."""
    grid = df.withColumn("rho", F.explode(F.array(*[F.lit(float(v)) for v in rates])))
    return grid.withColumn("noisy", flip_labels(label, key, F.col("rho"), seed))


def discriminant_accuracy(df: DataFrame, key: str, xs: Sequence[str], label: str, train: str, rates: Sequence[float], seed: int) -> DataFrame:
    """(rho, accuracy) of the linear discriminant; all rates share one grouped moment pass."""
    rows = noisy_rows(df, key, label, rates, seed)
    sums = moments(rows.where(F.col(train)), xs, by=["rho", "noisy"])

    @F.pandas_udf("array<double>")
    def gap(g1: pd.Series, n1: pd.Series, g0: pd.Series, n0: pd.Series) -> pd.Series:
        def one(a, n, b, m):
            ga, gb = symmetric(a), symmetric(b)
            ma, mb = ga[0, 1:] / n, gb[0, 1:] / m
            within = ga[1:, 1:] - n * np.outer(ma, ma) + gb[1:, 1:] - m * np.outer(mb, mb)
            precision = np.linalg.pinv(within / (n + m - 2))
            return [float(np.log(n / m) - 0.5 * (ma @ precision @ ma - mb @ precision @ mb)), *(precision @ (ma - mb))]

        return pd.Series([one(*v) for v in zip(g1, n1, g0, n0, strict=True)])

    pick = lambda c, v: F.first(F.when(F.col("noisy") == v, F.col(c)), ignorenulls=True).alias(f"{c}{v}")
    wide = sums.groupBy("rho").agg(pick("g", 1), pick("n", 1), pick("g", 0), pick("n", 0))
    forms = settle(wide.select("rho", gap("g1", "n1", "g0", "n0").alias("form")))
    scored = attach(rows.where(~F.col(train)), forms, ["rho"]).withColumn("score", linear_score(F.col("form"), xs))
    return scored.groupBy("rho").agg(F.avg(((F.col("score") > 0).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def grouped_logistic_accuracy(df: DataFrame, key: str, xs: Sequence[str], label: str, train: str, rates: Sequence[float], seed: int) -> DataFrame:
    """(rho, accuracy) of the logistic fit; all rates iterate together."""
    rows = noisy_rows(df, key, label, rates, seed)
    fits = logistic_regression(rows.where(F.col(train)), xs, "noisy", by=["rho"])
    scored = score_with(rows.where(~F.col(train)), fits, xs, "eta", ["rho"]).withColumn("p", logistic("eta"))
    return scored.groupBy("rho").agg(accuracy(label, "p").alias("accuracy"))


def _flipped_lists(rho: float, seed: int) -> Column:
    """The lists of a nearest join with the labels of training rows as they are after flipping."""
    return F.transform("neighbours", lambda n: F.struct(flip_labels(n["payload"], n["rid"], rho, seed).alias("payload")))


def neighbour_accuracy(
    df: DataFrame, key: str, features: str | Column, label: str, train: str, rates: Sequence[float], seed: int, ks: Sequence[int], classes: Sequence[int], folds: int = 5
) -> DataFrame:
    """(rho, k, accuracy) of nearest neighbours with k chosen by cross-validation on the noisy training rows.

    Distances don't depend on the labels: one join serves all rates, the cross-validation and the test rows, and labels
    are flipped in its lists.
    """
    rows = kfold(df.where(F.col(train).isNotNull()), key, folds, seed).withColumn("fold", F.when(F.col(train), F.col("fold")))
    near = nearest_join(rows, rows.where(F.col(train)), max(ks), key, key, features, label, mask="fold")
    votes = []
    for rho in rates:
        noisy = _flipped_lists(rho, seed)
        votes += [F.struct(F.lit(float(rho)).alias("rho"), F.lit(k).alias("k"), vote(noisy, k, classes).alias("predicted")) for k in ks]
    truth = rows.select(F.col(key).alias("qid"), F.col(label).alias("clean"), "fold")
    voted = near.select("qid", F.explode(F.array(*votes)).alias("c")).select("qid", "c.*").join(truth, "qid")
    right = lambda given: F.avg((F.col("predicted") == given).cast("double"))
    # test rows are no fold: their rows of the table are the accuracies on clean labels
    given = F.when(F.col("fold").isNull(), F.col("clean")).otherwise(flip_labels("clean", "qid", F.col("rho"), seed))
    scores = settle(voted.groupBy("rho", "k", "fold").agg(right(given).alias("a")))
    cv = scores.where("fold is not null").groupBy("rho", "k").agg(F.avg("a").alias("cv"))
    best = cv.groupBy("rho").agg(F.max_by("k", F.struct(F.round("cv", 12), -F.col("k"))).alias("k"))
    return scores.where("fold is null").join(best, ["rho", "k"]).select("rho", "k", F.col("a").alias("accuracy"))
