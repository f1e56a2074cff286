"""User models on Spark: batch scoring, model callbacks and per-group fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gramwise.operators.sampling import kfold


def score_column(
    spark: SparkSession,
    model: Any,
    features: Sequence[str | Column],
    method: str = "predict",
    returns: str = "double",
    batch_rows: int = 400,
) -> Column:
    """Predictions of any model with ``predict`` / ``predict_proba`` (or a plain callable) on (rows x features).

    The model is broadcast once and called on at most ``batch_rows`` rows at a time. Only the features travel
    to Python. ``returns`` is 'double' or 'array<double>' (class probabilities, quantiles).
    """
    # Closures and lambdas are models too, hence cloudpickle; each task unpacks the model once.
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = cloudpickle.loads(shipped.value)
        call = getattr(held, method) if hasattr(held, method) else held
        for rows in batches:
            if not len(rows):
                yield pd.Series([], dtype=object if returns.startswith("array") else float)
                continue
            x = np.stack(rows.to_numpy()).astype(float)
            parts = [np.asarray(call(x[i : i + batch_rows])) for i in range(0, len(x), batch_rows)]
            out = np.concatenate(parts)
            yield pd.Series(list(out)) if returns.startswith("array") else pd.Series(out.astype(float))

    columns = [F.col(f) if isinstance(f, str) else f for f in features]
    return apply(F.array(*[c.cast("double") for c in columns]))


def quantile_column(spark: SparkSession, model: Any, features, levels: Sequence[float], batch_rows: int = 400) -> Column:
    """Quantiles of a model whose ``predict(x, levels)`` gives one row of quantiles per input row."""
    levels = [float(v) for v in levels]
    predict = model.predict if hasattr(model, "predict") else model
    return score_column(spark, lambda x: predict(x, levels), features, returns="array<double>", batch_rows=batch_rows)


def cross_validated_score(
    df: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    key: str | Sequence[str],
    metric: Column,
    k: int = 5,
    seed: int = 1,
) -> DataFrame:
    """(fold, score) of a fitting callback: ``fit(train)`` gives ``score(rows)``, which adds ``prediction``.

    ``metric`` is any aggregate of the scored rows. Average the folds with ``fold_mean_score``.
    """
    folded = kfold(df, key, k, seed)
    out = None
    for fold in range(k):
        scorer = fit(folded.where(F.col("fold") != fold).drop("fold"))
        part = scorer(folded.where(F.col("fold") == fold)).groupBy("fold").agg(metric.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_groups(df: DataFrame, by: Sequence[str], fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most_rows: int | None = None) -> DataFrame:
    """A model per group: each group goes through ``fit`` as a pandas frame.

    Where groups may be large, pass ``most_rows``: a group with more is refused by an error before any work, never
    fitted in another way. Such groups need a fit on DataFrames, for instance ``least_squares(..., by=...)``.
    """
    by = list(by)
    if most_rows is not None:
        largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest > most_rows:
            raise ValueError(f"a group has {largest} rows, more than {most_rows}: use a fit on DataFrames with groups")
    return df.groupBy(*by).applyInPandas(fit, schema)
