"""Effect methods judged over replicates, and side by side on one train / test pair."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gramwise.operators.metrics import effect_metrics, mse

Method = Callable[[DataFrame, DataFrame], DataFrame]
"""(training rows, rows to score) -> scored rows with ``tau_hat``."""


def evaluate_replicates(df: DataFrame, methods: Mapping[str, Method], keys: Sequence[str], tau: str, t: str = "t") -> DataFrame:
    """(keys..., method, att_abs_err, cate_rmse): one row per replicate; the replicate is a grouping key of the fits."""
    out = None
    for name, method in methods.items():
        part = effect_metrics(method(df, df), keys, tau, "tau_hat", t).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def average_replicates(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over replicates and their number."""
    return metrics.groupBy(*keys).agg(
        F.avg("att_abs_err").alias("att_abs_err"), F.avg("cate_rmse").alias("cate_rmse"), F.count(F.lit(1)).alias("replicates")
    )


def compare_methods(train: DataFrame, test: DataFrame, methods: Mapping[str, Method], tau: str) -> DataFrame:
    """(method, mse): every method adds its effect as a column of the test rows; one aggregate judges all."""
    scored, names = test, []
    for i, (name, method) in enumerate(methods.items()):
        scored = method(train, scored).withColumnRenamed("tau_hat", f"__tau_{i}")
        names.append((name, f"__tau_{i}"))
    row = scored.agg(F.array(*[F.struct(F.lit(n).alias("method"), mse(tau, c).alias("mse")) for n, c in names]).alias("m"))
    return row.select(F.explode("m").alias("m")).select("m.*")
