"""Treatment-effect learners.

A learner is anything with ``fit(df, xs, y, weight, by) -> fit`` and ``fit.score(df, name, xs) -> df``. The linear one
fits all groups, arms and folds from grouped moments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.scalars import logistic
from gramwise.operators.encode import counterfactual_rows
from gramwise.operators.iterate import logistic_regression
from gramwise.operators.moments import (
    least_squares,
    linear_score,
    moments,
    out_of_fold_least_squares,
    score_with,
    solved,
)
from gramwise.operators.ranks import attach
from gramwise.operators.score import score_column
from gramwise.session import settle


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class _LinearFit:
    fits: DataFrame
    xs: list
    by: list[str]
    link: Callable[[Column], Column] | None = None

    def score(self, df: DataFrame, name: str, xs: Sequence[str | Column] | None = None) -> DataFrame:
        out = score_with(df, self.fits, xs or self.xs, name, self.by)
        return out if self.link is None else out.withColumn(name, self.link(F.col(name)))


@dataclass(frozen=True)
class LinearLearner:
    """Least squares; groups and folds share one pass."""

    ridge: float = 0.0

    def fit(self, df, xs, y, weight=None, by=()) -> _LinearFit:
        return _LinearFit(least_squares(df, xs, y, weight, by, self.ridge), list(xs), list(by))

    def fit_off_fold(self, df, xs, y, fold, by=()) -> _LinearFit:
        return _LinearFit(out_of_fold_least_squares(df, xs, y, fold, by=by), list(xs), [*by, fold])


@dataclass(frozen=True)
class LogisticLearner:
    """Unpenalised logistic fit; scores are probabilities."""

    max_iter: int = 50

    def fit(self, df, xs, y, weight=None, by=()) -> _LinearFit:
        fits = logistic_regression(df, xs, y, weight, by, max_iter=self.max_iter)
        return _LinearFit(fits, list(xs), list(by), logistic)

    def fit_off_fold(self, df, xs, y, fold, by=()) -> _LinearFit:
        """Rows enter once for every fold but their own; all folds iterate together."""
        found = [r[0] for r in df.select(fold).distinct().collect()]
        others = F.filter(F.array(*[F.lit(f) for f in sorted(found)]), lambda f: f != F.col(fold))
        long = df.withColumn("__off", F.explode(others)).drop(fold).withColumnRenamed("__off", fold)
        return self.fit(long, xs, y, by=[*by, fold])


@dataclass(frozen=True)
class _EstimatorFit:
    model: Any
    xs: list[str]
    probability: bool

    def score(self, df: DataFrame, name: str, xs: Sequence[str | Column] | None = None) -> DataFrame:
        columns = [f"__f{i}" for i in range(len(self.xs))]
        values = [_c(x).cast("double") for x in (xs or self.xs)]
        wide = df.withColumns(dict(zip(columns, values, strict=True)))
        rows = VectorAssembler(inputCols=columns, outputCol="__features").transform(wide)
        out = self.model.transform(rows)
        value = F.get(vector_to_array("probability"), 1) if self.probability else F.col("prediction")
        return out.select(*df.columns, value.alias(name))


@dataclass(frozen=True)
class EstimatorLearner:
    """Any ``pyspark.ml`` regressor, or classifier when ``probability`` is set."""

    estimator: Any
    probability: bool = False

    def fit(self, df, xs, y, weight=None, by=()) -> _EstimatorFit:
        if by:
            raise ValueError("a pyspark.ml estimator fits one table; filter the groups first")
        rows = df.select(
            *[_c(x).cast("double").alias(f"__f{i}") for i, x in enumerate(xs)],
            _c(y).cast("double").alias("__y"),
            *([_c(weight).cast("double").alias("__w")] if weight is not None else []),
        )
        columns = [f"__f{i}" for i in range(len(xs))]
        ready = VectorAssembler(inputCols=columns, outputCol="__features").transform(rows)
        settings = {self.estimator.featuresCol: "__features", self.estimator.labelCol: "__y"}
        if weight is not None:
            settings[self.estimator.weightCol] = "__w"
        return _EstimatorFit(self.estimator.fit(ready, settings), list(xs), self.probability)


@dataclass(frozen=True)
class _ModelFit:
    model: Any
    xs: list[str]
    method: str
    batch_rows: int

    def score(self, df: DataFrame, name: str, xs: Sequence[str | Column] | None = None) -> DataFrame:
        column = score_column(df.sparkSession, self.model, xs or self.xs, self.method, batch_rows=self.batch_rows)
        return df.withColumn(name, column)


@dataclass(frozen=True)
class ModelLearner:
    """A user's fitting function ``(df, xs, y, weight) -> model``; the model is scored in batches on executors."""

    fitter: Callable[..., Any]
    method: str = "predict"
    batch_rows: int = 400

    def fit(self, df, xs, y, weight=None, by=()) -> _ModelFit:
        if by:
            raise ValueError("a user model fits one table; filter the groups first")
        return _ModelFit(self.fitter(df, xs, y, weight), list(xs), self.method, self.batch_rows)


def cross_fit(df: DataFrame, learner, xs, y, fold: str, name: str, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Add out-of-fold predictions; ``where`` limits the rows used for fitting, not those scored."""
    train = df if where is None else df.where(where)
    if hasattr(learner, "fit_off_fold"):
        return learner.fit_off_fold(train, xs, y, fold, by).score(df, name)
    out = None
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        part = learner.fit(train.where(F.col(fold) != f), xs, y, by=by).score(df.where(F.col(fold) == f), name)
        out = part if out is None else out.unionByName(part)
    return out


def single_learner(df, test, xs, t, y, learner=LinearLearner(), by: Sequence[str] = ()) -> DataFrame:
    """One model on (x, t); effect = f(x, 1) - f(x, 0)."""
    fit = learner.fit(df, [*xs, t], y, by=by)
    out = fit.score(test, "__f1", [*xs, F.lit(1.0)])
    out = fit.score(out, "__f0", [*xs, F.lit(0.0)])
    return out.withColumn("tau_hat", F.col("__f1") - F.col("__f0")).drop("__f0", "__f1")


def single_learner_unfolded(df, test, key: Sequence[str], xs, t, y, learner=LinearLearner()) -> DataFrame:
    """The same effect with one scoring call over rows unfolded to both treatments: (key..., tau_hat)."""
    fit = learner.fit(df, [*xs, t], y)
    scored = fit.score(counterfactual_rows(test, t), "__f")
    signed = F.when(F.col(t) == 1, F.col("__f")).otherwise(-F.col("__f"))
    return scored.groupBy(*key).agg(F.sum(signed).alias("tau_hat"))


def _arm_outcomes(df, test, xs, t, y, learner, by, names=("__m0", "__m1")) -> DataFrame:
    if isinstance(learner, LinearLearner):
        # Both arms from one grouped pass.
        fits = settle(least_squares(df, xs, y, by=[*by, t], ridge=learner.ridge))
        side = lambda v: F.first(F.when(F.col(t) == v, F.col("theta")), ignorenulls=True).alias(f"__theta{v}")
        if not by:
            pair = fits.agg(side(0), side(1)).first()
            return test.withColumns({name: linear_score(pair[f"__theta{v}"], xs) for v, name in enumerate(names)})
        joined = attach(test, fits.groupBy(*by).agg(side(0), side(1)), by, "left")
        scores = {name: linear_score(F.col(f"__theta{v}"), xs) for v, name in enumerate(names)}
        return joined.withColumns(scores).drop("__theta0", "__theta1")
    out = test
    for value, name in enumerate(names):
        out = learner.fit(df.where(F.col(t) == value), xs, y, by=by).score(out, name)
    return out


def two_learner(df, test, xs, t, y, learner=LinearLearner(), by: Sequence[str] = ()) -> DataFrame:
    """One model per arm; effect = f1(x) - f0(x)."""
    out = _arm_outcomes(df, test, xs, t, y, learner, list(by))
    return out.withColumn("tau_hat", F.col("__m1") - F.col("__m0")).drop("__m0", "__m1")


def cross_learner(
    df, test, xs, t, y, learner=LinearLearner(), propensity=LogisticLearner(), effect=None, by: Sequence[str] = ()
) -> DataFrame:
    """Imputed effects per arm, regressed on x and blended by the propensity: e * tau0 + (1 - e) * tau1."""
    by, effect = list(by), effect or learner
    both = _arm_outcomes(df, df, xs, t, y, learner, by)
    gap = F.when(F.col(t) == 1, F.col(y) - F.col("__m0")).otherwise(F.col("__m1") - F.col(y))
    rows = both.withColumn("__d", gap)
    out = _arm_outcomes(rows, test, xs, t, "__d", effect, by, ("__tau0", "__tau1"))
    out = propensity.fit(df, xs, t, by=by).score(out, "__e")
    blend = F.col("__e") * F.col("__tau0") + (1.0 - F.col("__e")) * F.col("__tau1")
    return out.withColumn("tau_hat", blend).drop("__tau0", "__tau1", "__e")


def doubly_robust_rows(
    df, xs, t, y, fold, learner=LinearLearner(), propensity=LogisticLearner(), floor: float = 0.1, by: Sequence[str] = ()
) -> DataFrame:
    """Add the pseudo-outcome ``psi`` with out-of-fold nuisances and floored arm propensities."""
    rows = cross_fit(df, learner, xs, y, fold, "__m0", by, F.col(t) == 0)
    rows = cross_fit(rows, learner, xs, y, fold, "__m1", by, F.col(t) == 1)
    rows = cross_fit(rows, propensity, xs, t, fold, "__e", by)
    one = F.col("__m1") + F.col(t) * (F.col(y) - F.col("__m1")) / F.greatest(F.col("__e"), F.lit(floor))
    zero = F.col("__m0") + (1 - F.col(t)) * (F.col(y) - F.col("__m0")) / F.greatest(1.0 - F.col("__e"), F.lit(floor))
    return rows.withColumn("psi", one - zero).drop("__m0", "__m1", "__e")


def doubly_robust_learner(
    df, test, xs, t, y, fold, learner=LinearLearner(), propensity=LogisticLearner(), final=None, floor=0.1, by: Sequence[str] = ()
) -> DataFrame:
    rows = doubly_robust_rows(df, xs, t, y, fold, learner, propensity, floor, by)
    return (final or LinearLearner()).fit(rows, xs, "psi", by=by).score(test, "tau_hat")


def residual_rows(df, xs, t, y, fold, learner=LinearLearner(), propensity=LogisticLearner(), by: Sequence[str] = ()) -> DataFrame:
    """Add out-of-fold residuals ``ry`` = y - m(x) and ``rt`` = t - e(x)."""
    rows = cross_fit(df, learner, xs, y, fold, "__m", by)
    rows = cross_fit(rows, propensity, xs, t, fold, "__e", by)
    return rows.withColumns({"ry": F.col(y) - F.col("__m"), "rt": F.col(t) - F.col("__e")}).drop("__m", "__e")


def residual_effect(rows: DataFrame, test: DataFrame, xs, final=None, by: Sequence[str] = ()) -> DataFrame:
    """Effect minimising sum (ry - rt tau(x))^2: in closed form when linear, else weighted by rt^2 on ry / rt."""
    if final is None:
        scaled = [F.col("rt"), *[F.col("rt") * _c(x) for x in xs]]
        fits = solved(moments(rows, scaled, ["ry"], by=by, intercept=False))
        return score_with(test, fits, xs, "tau_hat", by)
    usable = rows.where(F.abs("rt") > 1e-12).withColumns({"__q": F.col("ry") / F.col("rt"), "__w2": F.col("rt") * F.col("rt")})
    return final.fit(usable, xs, "__q", "__w2", by).score(test, "tau_hat")


def residual_learner(
    df, test, xs, t, y, fold, learner=LinearLearner(), propensity=LogisticLearner(), final=None, by: Sequence[str] = (), controls: Sequence[str] = ()
) -> DataFrame:
    """Double machine learning with cross-fitted nuisances on x and controls; the effect depends on x."""
    rows = residual_rows(df, [*xs, *controls], t, y, fold, learner, propensity, by)
    return residual_effect(rows, test, xs, final, by)


def known_nuisance_learner(
    df, test, xs, t, y, base: Callable[[Mapping[str, Column]], Column], tau: Callable[[Mapping[str, Column]], Column],
    propensity: Callable[[Mapping[str, Column]], Column], final=None, by: Sequence[str] = (),
) -> DataFrame:
    """Residual learner whose nuisances are given: e(x), and m(x) = base(x) + tau(x) (e(x) - 1/2)."""
    cols = {x: F.col(x) for x in xs}
    e = propensity(cols)
    m = base(cols) + tau(cols) * (e - 0.5)
    rows = df.withColumns({"ry": F.col(y) - m, "rt": F.col(t) - e})
    return residual_effect(rows, test, xs, final, by)


def with_propensity(df, test, xs, t, propensity=LogisticLearner(), name="e_hat", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables with the fitted propensity as one more feature."""
    fit = propensity.fit(df, xs, t, by=by)
    return fit.score(df, name), fit.score(test, name)


def propensity_single_learner(df, test, xs, t, y, learner=LinearLearner(), propensity=LogisticLearner(), by: Sequence[str] = ()) -> DataFrame:
    train, target = with_propensity(df, test, xs, t, propensity, by=by)
    return single_learner(train, target, [*xs, "e_hat"], t, y, learner, by)


def propensity_cross_learner(df, test, xs, t, y, learner=LinearLearner(), propensity=LogisticLearner(), by: Sequence[str] = ()) -> DataFrame:
    train, target = with_propensity(df, test, xs, t, propensity, by=by)
    return cross_learner(train, target, [*xs, "e_hat"], t, y, learner, propensity, by=by)


def best_by_cv(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    candidates: Mapping[str, tuple[Any, Mapping[str, Sequence]]],
    weight: str | None = None,
    folds: int = 2,
    seed: int = 0,
    evaluator: Any = None,
    parallelism: int = 4,
) -> tuple[str, Any, DataFrame]:
    """Choose among ``pyspark.ml`` estimators and their grids by k-fold CV: (name, fitted model, score table).

    Candidates map a name to (estimator, {parameter name: values}). Scores come from ``evaluator`` (RMSE by default).
    """
    ready = VectorAssembler(inputCols=list(xs), outputCol="features").transform(
        df.select(*[F.col(x).cast("double") for x in xs], F.col(y).cast("double").alias("label"), *([F.col(weight)] if weight else []))
    ).persist()
    evaluator = evaluator or RegressionEvaluator(metricName="rmse", **({"weightCol": weight} if weight else {}))
    rows, best = [], None
    try:
        for name, (estimator, grid) in candidates.items():
            builder = ParamGridBuilder()
            for parameter, values in grid.items():
                builder = builder.addGrid(estimator.getParam(parameter), list(values))
            if weight and estimator.hasParam("weightCol"):
                estimator = estimator.copy({estimator.weightCol: weight})
            model = CrossValidator(
                estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism
            ).fit(ready)
            sign = -1.0 if evaluator.isLargerBetter() else 1.0
            for setting, value in zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True):
                rows.append((name, ",".join(f"{p.name}={v}" for p, v in setting.items()), float(value)))
                if best is None or sign * value < best[0]:
                    best = (sign * value, name, None)
            if best[1] == name and best[2] is None:
                best = (best[0], name, model.bestModel)
    finally:
        ready.unpersist()
    return best[1], best[2], df.sparkSession.createDataFrame(rows, "candidate string, setting string, score double")
