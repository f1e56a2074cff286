"""Accumulated local effects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.functions.lookups import bin_of, literal_array
from gramwise.operators.ranks import order_statistic_edges, running_effects

Predict = Callable[[Mapping[str, Column]], Column]
"""Prediction as a column of feature columns; wrap a user model with ``score_column``."""


def feature_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantile edges of every feature, from one unpivoted pass. At most bins+1 values per feature."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("c")
    ).select("c.*")
    edges: dict[str, list[float]] = {f: [] for f in features}
    for row in order_statistic_edges(long, "x", bins, ["feature"]).collect():
        edges[row["feature"]].append(row["value"])
    return {f: sorted(v) for f, v in edges.items()}


def local_differences(df: DataFrame, features: Sequence[str], edges: Mapping[str, Sequence[float]], predict: Predict, all_features: Sequence[str]) -> DataFrame:
    """(feature, bin, delta) per row and feature: prediction at the right edge of its bin minus at the left edge."""
    base = {f: F.col(f) for f in all_features}
    cells = []
    for f in features:
        grid = literal_array(edges[f])
        slot = bin_of(F.col(f).cast("double"), grid)
        delta = predict({**base, f: F.get(grid, slot)}) - predict({**base, f: F.get(grid, slot - 1)})
        cells.append(F.struct(F.lit(f).alias("feature"), slot.alias("bin"), delta.alias("delta")))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def accumulated_effects(
    df: DataFrame,
    features: Sequence[str],
    predict: Predict,
    all_features: Sequence[str] | None = None,
    bins: int = 20,
    band: float | None = None,
) -> DataFrame:
    """(feature, bin, edge, size, eff), centred by bin sizes; with ``band`` also (lower, upper) at that confidence.

    Row 0 of each feature is the smallest edge with size 0.
    """
    all_features = list(all_features or features)
    edges = feature_edges(df, features, bins)
    deltas = local_differences(df, features, edges, predict, all_features)
    per_bin = deltas.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("size"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd")
    )
    spark = df.sparkSession
    slots = spark.createDataFrame(
        [(f, b, float(e)) for f in features for b, e in enumerate(edges[f])], "feature string, bin int, edge double"
    )
    filled = slots.join(F.broadcast(per_bin), ["feature", "bin"], "left").withColumns(
        {"size": F.coalesce("size", F.lit(0)), "mean": F.coalesce("mean", F.lit(0.0))}
    )
    # A few rows per feature from here on.
    run = running_effects(filled, "bin", "mean", ["feature"])
    w = Window.partitionBy("feature")
    centre = F.sum(F.col("size") * F.col("midpoint")).over(w) / F.sum("size").over(w)
    out = run.withColumn("eff", F.col("cumulative") - centre)
    keep = ["feature", "bin", "edge", "size", "eff"]
    if band is None:
        return out.select(*keep)
    half = F.coalesce(F.lit(NormalDist().inv_cdf(0.5 + band / 2.0)) * F.col("sd") / F.sqrt("size"), F.lit(0.0))
    return out.select(*keep, (F.col("eff") - half).alias("lower"), (F.col("eff") + half).alias("upper"))
