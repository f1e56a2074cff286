"""Penalty selection under covariate shift, repeated over random splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gramwise.operators.encode import tilt_weights
from gramwise.operators.metrics import mean_and_error
from gramwise.operators.sampling import train_test_split, weighted_resample
from gramwise.operators.shift import penalty_paths


def shifted_split(df: DataFrame, key: str, xs: Sequence[str], beta: Sequence[float], test_fraction: float, seed: int, hold: float = 0.5) -> DataFrame:
    """Rows with ``part`` fit / hold / target: the test split is resampled with weights exp(x'beta) to induce a shift."""
    split = train_test_split(df, key, test_fraction=test_fraction, seed=seed)
    source = train_test_split(split.where(F.col("split") == "train"), key, test_fraction=hold, seed=seed + 1, name="half")
    source = source.withColumn("part", F.when(F.col("half") == "test", "hold").otherwise("fit"))
    test = tilt_weights(split.where(F.col("split") == "test"), xs, beta)
    target = weighted_resample(test, [key], "w", test.count()).withColumn("part", F.lit("target"))
    keep = [*df.columns, "part"]
    return source.select(*keep).unionByName(target.select(*keep))


def repeat(
    df: DataFrame, key: str, xs: Sequence[str], y: str, features: Sequence[Column], beta: Sequence[float], seeds: Sequence[int], test_fraction: float = 0.3
) -> DataFrame:
    """(rep, method, err, lambda): target error and chosen penalty per repetition; one moment pass serves all of them."""
    rows = None
    for seed in seeds:
        part = shifted_split(df, key, xs, beta, test_fraction, seed).withColumn("rep", F.lit(int(seed)))
        rows = part if rows is None else rows.unionByName(part)
    out = []
    for (rep,), path in sorted(penalty_paths(rows, "part", features, y, ["rep"]).items()):
        errors = {r["idx"]: r["real"] for r in path.table.collect()}
        out += [(rep, m, float(errors[j]), float(path.penalties[j])) for m, j in path.chosen.items()]
    return df.sparkSession.createDataFrame(out, "rep int, method string, err double, lambda double")


def summarise(results: DataFrame) -> DataFrame:
    """(method, mean, se, lambda): mean error with its standard error over repetitions, and the mean penalty."""
    errors = mean_and_error(results, "err", ["method"])
    return errors.join(results.groupBy("method").agg(F.avg("lambda").alias("lambda")), "method")
