"""Sparse regression with the minimax concave penalty, from moments alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.operators.moments import moments, symmetric

# Path length, smallest penalty as a share of the largest, concavity.
PATH_LENGTH = 50
MIN_RATIO = 0.05
CONCAVITY = 3.0


def penalty_sequence(rhs: np.ndarray, n: float, length: int = PATH_LENGTH, ratio: float = MIN_RATIO) -> np.ndarray:
    """Geometric path down from the smallest penalty at which every coefficient is zero."""
    top = float(np.max(np.abs(rhs))) / n
    return top * ratio ** (np.arange(length) / (length - 1))


def mcp_coefficients(gram: np.ndarray, rhs: np.ndarray, n: float, penalties: np.ndarray, gamma: float = CONCAVITY) -> np.ndarray:
    """Coordinate descent for (1/2n)|y - Xb|^2 + MCP(b) at each penalty, warm-started along the path: (length x d).

    Works on unit-variance columns and returns coefficients on the scale of the data; only the d x d Gram is used.
    """
    scale = np.sqrt(np.maximum(np.diag(gram) / n, 1e-300))
    g, c = gram / n / np.outer(scale, scale), rhs / n / scale
    d = len(c)
    b, gradient = np.zeros(d), c.copy()
    out = np.zeros((len(penalties), d))
    for m, lam in enumerate(penalties):
        for _ in range(500):
            moved = 0.0
            for j in range(d):
                u = gradient[j] + b[j]
                if abs(u) <= gamma * lam:
                    new = np.sign(u) * max(abs(u) - lam, 0.0) / (1.0 - 1.0 / gamma)
                else:
                    new = u
                if new != b[j]:
                    gradient -= g[:, j] * (new - b[j])
                    moved = max(moved, abs(new - b[j]))
                    b[j] = new
            if moved < 1e-9:
                break
        out[m] = b / scale
    return out


def _sides(df: DataFrame, xs, y, fold: str | None) -> list[dict]:
    rows = moments(df, xs, [y], by=[fold] if fold else [], intercept=False, cross=True).collect()
    return [{"n": r["n"], "gram": symmetric(r["g"]), "rhs": np.asarray(r["b"]), "yy": r["rr"][0]} for r in rows]


def _path_frame(spark, penalties, betas) -> DataFrame:
    rows = [
        (m, float(lam), [float(v) for v in beta], int(np.count_nonzero(beta))) for m, (lam, beta) in enumerate(zip(penalties, betas, strict=True))
    ]
    return spark.createDataFrame(rows, "idx int, lambda double, beta array<double>, nonzero int")


def mcp_path(df: DataFrame, xs: Sequence[str | Column], y: str | Column, length: int = PATH_LENGTH, ratio: float = MIN_RATIO, gamma: float = CONCAVITY) -> DataFrame:
    """(idx, lambda, beta, nonzero) without intercept; one pass over the data."""
    (side,) = _sides(df, xs, y, None)
    # Penalties refer to unit-variance columns.
    scale = np.sqrt(np.maximum(np.diag(side["gram"]) / side["n"], 1e-300))
    penalties = penalty_sequence(side["rhs"] / scale, side["n"], length, ratio)
    return _path_frame(df.sparkSession, penalties, mcp_coefficients(side["gram"], side["rhs"], side["n"], penalties, gamma))


def mcp_cross_validated(
    df: DataFrame, xs: Sequence[str | Column], y: str | Column, fold: str, length: int = PATH_LENGTH, ratio: float = MIN_RATIO, gamma: float = CONCAVITY
) -> tuple[DataFrame, int]:
    """The path with the mean over folds of the held-out squared error: ((idx, lambda, beta, nonzero, cv_mse), best index).

    Training Grams are total minus fold, and held-out errors are quadratic forms in fold moments: one pass in all.
    The penalties come from the full data and are shared by the folds.
    """
    folds = _sides(df, xs, y, fold)
    total = {k: sum(f[k] for f in folds) for k in ("n", "gram", "rhs", "yy")}
    scale = np.sqrt(np.maximum(np.diag(total["gram"]) / total["n"], 1e-300))
    penalties = penalty_sequence(total["rhs"] / scale, total["n"], length, ratio)
    scores = []
    for f in folds:
        betas = mcp_coefficients(total["gram"] - f["gram"], total["rhs"] - f["rhs"], total["n"] - f["n"], penalties, gamma)
        fit = np.einsum("md,de,me->m", betas, f["gram"], betas)
        scores.append((f["yy"] - 2.0 * betas @ f["rhs"] + fit) / f["n"])
    mean = np.mean(scores, axis=0)
    best = int(np.argmin(mean))
    betas = mcp_coefficients(total["gram"], total["rhs"], total["n"], penalties, gamma)
    path = _path_frame(df.sparkSession, penalties, betas)
    cv = df.sparkSession.createDataFrame([(m, float(v)) for m, v in enumerate(mean)], "idx int, cv_mse double")
    return path.join(F.broadcast(cv), "idx"), best


def distilled(df: DataFrame, predictions: DataFrame, key: str, xs, prediction: str, fold: str, **options) -> tuple[DataFrame, int]:
    """The cross-validated path fitted to another model's stored predictions instead of the response."""
    return mcp_cross_validated(df.join(predictions.select(key, prediction), key), xs, prediction, fold, **options)
