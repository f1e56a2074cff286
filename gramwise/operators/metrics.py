"""Scores of predictions and summaries over replicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.operators.ranks import auc
from gramwise.session import settle


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squared_error(y, prediction) -> Column:
    e = _c(y) - _c(prediction)
    return e * e


def mse(y, prediction) -> Column:
    return F.avg(squared_error(y, prediction))


def rmse(y, prediction) -> Column:
    return F.sqrt(mse(y, prediction))


def importance_weighted_mse(y, prediction, weight) -> Column:
    return F.sum(_c(weight) * squared_error(y, prediction)) / F.sum(_c(weight))


def weighted_loss(y, prediction, weight) -> Column:
    """mean(w e^2): not divided by the weight sum."""
    return F.avg(_c(weight) * squared_error(y, prediction))


def accuracy(y, p, cut: float = 0.5) -> Column:
    return F.avg(((_c(p) >= F.lit(cut)).cast("int") == _c(y)).cast("double"))


def coverage(y, lower, upper) -> Column:
    return F.avg(((_c(lower) <= _c(y)) & (_c(y) <= _c(upper))).cast("double"))


def mean_width(lower, upper) -> Column:
    return F.avg(_c(upper) - _c(lower))


def metric_table(df: DataFrame, by: Sequence[str], **metrics: Column) -> DataFrame:
    """One grouped aggregate of named metric expressions, user-supplied ones included."""
    return df.groupBy(*by).agg(*[m.alias(name) for name, m in metrics.items()])


def replicate_metrics(df: DataFrame, estimate: str, truth: str, by: Sequence[str], term: str = "term") -> DataFrame:
    """Per term over replicates: bias, population variance, mean squared error."""
    return df.groupBy(*by, term).agg(
        F.avg(_c(estimate) - _c(truth)).alias("bias"),
        F.var_pop(estimate).alias("variance"),
        F.avg(squared_error(estimate, truth)).alias("mse"),
    )


def average_over_terms(per_term: DataFrame, by: Sequence[str]) -> DataFrame:
    """Averages of the per-term values (not pooled)."""
    return per_term.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("bias", "variance", "mse")])


def term_errors(estimates: DataFrame, truth: DataFrame, term: str = "term") -> DataFrame:
    """Squared error of every estimate against the full-data value of the same term."""
    reference = truth.select(term, F.col("theta").alias("truth"))
    return estimates.join(reference, term).withColumn("sq_error", squared_error("theta", "truth"))


def mean_and_error(df: DataFrame, column: str, by: Sequence[str] = (), within: bool = False) -> DataFrame:
    """Mean and standard error: sample deviation across repeats, population deviation within one test set."""
    deviation = F.stddev_pop(column) if within else F.stddev_samp(column)
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), (deviation / F.sqrt(F.count(column))).alias("se"))


def effect_metrics(df: DataFrame, by: Sequence[str], tau: str, tau_hat: str, t: str = "t") -> DataFrame:
    """Absolute error of the mean effect on the treated, and RMSE of unit effects."""
    treated = lambda c: F.avg(F.when(F.col(t) == 1, F.col(c)))
    return df.groupBy(*by).agg(
        F.abs(treated(tau) - treated(tau_hat)).alias("att_abs_err"), rmse(tau, tau_hat).alias("cate_rmse")
    )


def accuracy_and_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    first = df.groupBy(*by).agg(accuracy(y, p).alias("accuracy"))
    area = auc(df, y, p, by)
    return first.join(area, by) if by else first.join(F.broadcast(area))


def label_shares(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[int]) -> DataFrame:
    """P(predicted | true) for every pair of the listed classes; absent cells are 0."""
    pairs = [(a, b) for a in classes for b in classes]
    cells = df.agg(
        *[F.count_if((F.col(truth) == a) & (F.col(predicted) == b)).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(F.col(truth) == a).alias(f"t_{a}") for a in classes],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("true_label"),
                F.lit(b).alias("predicted_label"),
                F.when(F.col(f"t_{a}") > 0, F.col(f"c_{i}") / F.col(f"t_{a}")).otherwise(0.0).alias("rate"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return cells.select(F.explode(entries).alias("e")).select("e.*")


def pick_best(df: DataFrame, parameter: str, score: str, index: str, by: Sequence[str] = (), smallest: bool = True) -> DataFrame:
    """The parameter with the best score; ties go to the smallest index."""
    value = F.col(score) if smallest else -F.col(score)
    order = F.struct(value.alias("s"), F.col(index).alias("i"))
    return df.groupBy(*by).agg(
        F.min_by(parameter, order).alias(parameter), F.min_by(score, order).alias(score), F.min_by(index, order).alias(index)
    )


def group_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Means per group, optionally rounded to the stated digits; apply twice for a mean of means."""
    mean = lambda c: F.avg(c) if digits is None else F.round(F.avg(c), digits)
    return df.groupBy(*by).agg(*[mean(c).alias(c) for c in columns])


def curve(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean and population deviation per group (a calibration curve when grouped by nominal level)."""
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))


def wide_table(df: DataFrame, rows: str, columns: str, names: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Pivot with stated column names: no extra job to discover them."""
    out = df.groupBy(rows).pivot(columns, list(names)).agg(F.first(value, ignorenulls=True))
    return out.select(rows, *[F.round(F.col(f"`{n}`"), digits).alias(n) for n in names])


def slice_table(df: DataFrame, slice_column: str, columns: Sequence[str], weights: str = "share") -> DataFrame:
    """Slice weight and slice means. 'share' weighs by rows, 'equal' gives every slice 1 / #slices."""
    counts = df.groupBy(slice_column).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    counts = settle(counts)
    whole = counts.agg(F.sum("n").alias("__rows"), F.count(F.lit(1)).alias("__slices"))
    share = F.col("n") / F.col("__rows") if weights == "share" else F.lit(1.0) / F.col("__slices")
    return counts.crossJoin(F.broadcast(whole)).withColumn("share", share).drop("__rows", "__slices")


def fold_mean_score(df: DataFrame, fold: str, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-fold scores, each fold counting once."""
    folds = df.groupBy(*by, fold).agg(score.alias("score"))
    return folds.groupBy(*by).agg(F.avg("score").alias("score"))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
