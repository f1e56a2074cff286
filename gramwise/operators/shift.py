"""Model selection and evaluation when the target distribution differs from the source."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.operators.metrics import mean_and_error, squared_error
from gramwise.operators.moments import linear_score, moments, symmetric


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def step_features(x: str | Column, knots: Sequence[float], n: float = 1.0) -> list[Column]:
    """Indicators of x at or above each knot, scaled so that their inner product approximates min(x, z) / n.

    Knots are equally spaced on (0, 1]; the approximation error is at most one knot step.
    """
    scale = math.sqrt(1.0 / (len(knots) * n))
    return [F.when(_c(x) >= F.lit(float(t)), F.lit(scale)).otherwise(F.lit(0.0)) for t in knots]


def fourier_features(xs: Sequence[str | Column], count: int, gamma: float | None = None, seed: int = 0) -> list[Column]:
    """Random cosine features whose inner product approximates exp(-gamma |x - z|^2); gamma = 1/p by default.

    The error falls with the square root of ``count``; report it with every result.
    """
    gamma = 1.0 / len(xs) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((count, len(xs))) * math.sqrt(2.0 * gamma)
    phase = rng.uniform(0.0, 2.0 * math.pi, count)
    scale = F.lit(math.sqrt(2.0 / count))
    return [scale * F.cos(linear_score([phase[i], *omega[i]], xs)) for i in range(count)]


def penalty_grid(n: int, ratio: float = 2.0, first: float | None = None) -> list[float]:
    """Penalties 0.1/n, then multiplied by ``ratio`` until 1 is reached; at least three."""
    first = 0.1 / n if first is None else first
    steps = max(math.ceil(math.log(1.0 / first) / math.log(ratio)), 2) + 1
    return [first * ratio**j for j in range(steps)]


@dataclass(frozen=True)
class PenaltyPath:
    """Ridge path on a feature map with its three error columns and the three selections."""

    table: DataFrame
    penalties: list[float]
    thetas: list[np.ndarray]
    imputer: np.ndarray
    features: list[Column]
    chosen: dict[str, int]

    def predictions(self, df: DataFrame, methods: Sequence[str] = ("naive", "pseudo", "real")) -> DataFrame:
        """Add a prediction column per selection; no intercept beyond the feature map."""
        return df.withColumns(
            {f"p_{m}": linear_score([0.0, *self.thetas[self.chosen[m]]], self.features) for m in methods}
        )


def _path_of(spark, side: dict, features: Sequence[Column], ratio: float) -> PenaltyPath:
    n = side["fit"]["n"] + side["hold"]["n"]
    penalties = penalty_grid(n, ratio)

    def ridge(s, penalty):
        return np.linalg.solve(s["gram"] + penalty * np.eye(len(s["gram"])), s["rhs"])

    def error(s, theta):
        return float(s["yy"] - 2.0 * theta @ s["rhs"] + theta @ s["gram"] @ theta) / s["n"]

    imputer = ridge(side["hold"], 0.1 / n)
    thetas = [ridge(side["fit"], lam) for lam in penalties]
    target = side["target"]
    table = []
    for j, (lam, theta) in enumerate(zip(penalties, thetas, strict=True)):
        gap = theta - imputer
        pseudo = float(gap @ target["gram"] @ gap) / target["n"]
        table.append((j, lam, error(side["hold"], theta), pseudo, error(target, theta)))
    chosen = {name: min(range(len(table)), key=lambda j, c=c: (table[j][c], j)) for c, name in ((2, "naive"), (3, "pseudo"), (4, "real"))}
    frame = spark.createDataFrame(table, "idx int, lambda double, naive double, pseudo double, real double")
    return PenaltyPath(frame, penalties, thetas, imputer, list(features), chosen)


def penalty_paths(
    df: DataFrame, part: str, features: Sequence[Column], y: str, by: Sequence[str] = (), ratio: float = 2.0
) -> dict[tuple, PenaltyPath]:
    """A penalty path per group (per repetition), from one pass over the data.

    Fits use part 'fit'. Every penalty is judged by held-out source rows ('hold': naive), by labels imputed on the
    target with a fit on 'hold' (pseudo), and by the target's own labels (real). All errors are quadratic forms in
    the moments of the three parts.
    """
    by = list(by)
    sides: dict[tuple, dict] = {}
    for r in moments(df, features, [y], by=[*by, part], intercept=False, cross=True).collect():
        group = sides.setdefault(tuple(r[k] for k in by), {})
        group[r[part]] = {"n": r["n"], "gram": symmetric(r["g"]), "rhs": np.asarray(r["b"]), "yy": r["rr"][0]}
    return {key: _path_of(df.sparkSession, side, features, ratio) for key, side in sides.items()}


def penalty_path(df: DataFrame, part: str, features: Sequence[Column], y: str, ratio: float = 2.0) -> PenaltyPath:
    return penalty_paths(df, part, features, y, (), ratio)[()]


def excess_risk(df: DataFrame, truth: str, methods: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., method, mean, se) of squared gaps between truth and the columns p_<method>; one pass."""
    cells = [F.struct(F.lit(m).alias("method"), squared_error(truth, f"p_{m}").alias("e")) for m in methods]
    long = df.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")
    return mean_and_error(long, "e", [*by, "method"], within=True)


def candidate_risk(df: DataFrame, truth: str, path: PenaltyPath, candidates: Sequence[int]) -> DataFrame:
    """Excess risk of listed path members: (idx, mean, se)."""
    scored = df.withColumns({f"p_{j}": linear_score([0.0, *path.thetas[j]], path.features) for j in candidates})
    risk = excess_risk(scored, truth, [str(j) for j in candidates])
    return risk.select(F.col("method").cast("int").alias("idx"), "mean", "se")


def tuned_trees(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    grid: dict[str, Sequence],
    weight: str | None = None,
    folds: int = 3,
    seed: int = 0,
    parallelism: int = 4,
):
    """Boosted trees chosen by grid and CV: (fitted model, {parameter: value}). ``weight`` weighs the loss."""
    ready = VectorAssembler(inputCols=list(xs), outputCol="features").transform(
        df.select(*[F.col(x).cast("double") for x in xs], F.col(y).cast("double").alias("label"), *([F.col(weight).cast("double").alias("weight")] if weight else []))
    ).persist()
    trees = GBTRegressor(seed=seed, **({"weightCol": "weight"} if weight else {}))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(trees.getParam(name), list(values))
    try:
        fitted = CrossValidator(
            estimator=trees, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(metricName="mse"), numFolds=folds, seed=seed, parallelism=parallelism
        ).fit(ready)
    finally:
        ready.unpersist()
    best = int(np.argmin(fitted.avgMetrics))
    return fitted.bestModel, {p.name: v for p, v in fitted.getEstimatorParamMaps()[best].items()}


def refit_trees(df: DataFrame, xs: Sequence[str], y: str, parameters: dict, weight: str | None = None, seed: int = 0):
    """Boosted trees with chosen parameters."""
    return tuned_trees(df, xs, y, {k: [v] for k, v in parameters.items()}, weight, folds=2, seed=seed)[0]


def tree_predictions(df: DataFrame, model, xs: Sequence[str], name: str) -> DataFrame:
    ready = df.withColumns({f"__f{i}": F.col(x).cast("double") for i, x in enumerate(xs)})
    rows = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(xs))], outputCol="features").transform(ready)
    return model.transform(rows).select(*df.columns, F.col("prediction").alias(name))


def corrected_prior(df: DataFrame, split: str, label: str, predicted: str, classes: Sequence[int], low: float = 1e-6) -> DataFrame:
    """Target class shares from predicted ones: (label, source, target).

    ``split`` holds 'train', 'calibration' and 'target' marks as an array column, since calibration rows may also be
    training rows. The column-normalised confusion matrix of the calibration rows is inverted by pseudo-inverse;
    shares are clipped to [low, 1] and normalised.
    """
    k = len(classes)
    has = lambda s: F.array_contains(F.col(split), s)
    sums = [F.count_if(has("calibration") & (F.col(predicted) == p) & (F.col(label) == c)) for p in classes for c in classes]
    sums += [F.count_if(has("target") & (F.col(predicted) == p)) for p in classes]
    sums += [F.count_if(has("train") & (F.col(label) == c)) for c in classes]
    v = np.array(df.agg(F.array(*sums).alias("v")).first()["v"], dtype=float)
    table, predicted_share, source = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[k * k + k :]
    totals = table.sum(axis=0)
    matrix = np.divide(table, totals, out=np.zeros_like(table), where=totals > 0)
    solved = np.clip(np.linalg.pinv(matrix) @ (predicted_share / predicted_share.sum()), low, 1.0)
    solved, source = solved / solved.sum(), source / source.sum()
    rows = [(int(c), float(s), float(t)) for c, s, t in zip(classes, source, solved, strict=True)]
    return df.sparkSession.createDataFrame(rows, "label int, source double, target double")


def reweighted_posterior(p1, source: Sequence[float], target: Sequence[float]) -> Column:
    """P(1 | x) after the class shares change from source to target."""
    p = F.col(p1) if isinstance(p1, str) else p1
    one = p * F.lit(float(target[1]) / float(source[1]))
    zero = (1.0 - p) * F.lit(float(target[0]) / float(source[0]))
    return one / (one + zero)


