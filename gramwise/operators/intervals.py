"""Predictive quantiles and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions.lookups import probability_transform, quantile_score
from gramwise.operators.encode import region
from gramwise.operators.metrics import coverage, mean_width

# Nominal interval levels and the interior grid of the quantile score.
NOMINAL = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
INTERIOR = tuple(round(0.05 * k, 3) for k in range(1, 20))


def interval_levels(nominal: Sequence[float] = NOMINAL, interior: Sequence[float] = INTERIOR) -> list[float]:
    """All quantile levels needed: both ends of every nominal interval and the interior grid, rounded and distinct."""
    ends = [round((1 - c) / 2, 3) for c in nominal] + [round((1 + c) / 2, 3) for c in nominal]
    return sorted({*ends, *[round(v, 3) for v in interior]})


def gaussian_quantiles(mu, variance, noise: float, levels: Sequence[float]) -> Column:
    """Quantile array of a normal prediction with variance = model variance + noise^2."""
    mu = F.col(mu) if isinstance(mu, str) else mu
    variance = F.col(variance) if isinstance(variance, str) else variance
    z = F.array(*[F.lit(NormalDist().inv_cdf(a)) for a in levels])
    return F.transform(z, lambda v: mu + F.sqrt(variance + F.lit(noise * noise)) * v)


def _end(q, levels: Sequence[float], a: float) -> Column:
    return F.get(F.col(q) if isinstance(q, str) else q, list(levels).index(round(a, 3)))


def scored_rows(df: DataFrame, y: str, q: str, levels: Sequence[float]) -> DataFrame:
    """Add ``pit`` and ``crps``; one projection."""
    inner = [i for i, a in enumerate(levels) if a in INTERIOR]
    interior = F.array(*[F.get(F.col(q), i) for i in inner])
    return df.withColumns(
        {
            "pit": probability_transform(y, q, levels),
            "crps": quantile_score(y, interior, [levels[i] for i in inner]),
        }
    )


def interval_summary(df: DataFrame, y: str, q: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Coverage at every nominal level, mean width at 95% and mean CRPS, in one aggregate: (by..., cov_*, width_95, crps)."""
    rows = scored_rows(df, y, q, levels)
    found = {f"cov_{round(100 * c)}": coverage(y, _end(q, levels, (1 - c) / 2), _end(q, levels, (1 + c) / 2)) for c in NOMINAL}
    width = mean_width(_end(q, levels, 0.025), _end(q, levels, 0.975))
    return rows.groupBy(*by).agg(
        *[v.alias(k) for k, v in found.items()], width.alias("width_95"), F.avg("crps").alias("crps")
    )


def coverage_rows(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary's coverage columns as (keys..., level, coverage)."""
    cells = [F.struct(F.lit(c).alias("level"), F.col(f"cov_{round(100 * c)}").alias("coverage")) for c in NOMINAL]
    return summary.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def region_coverage(df: DataFrame, x, y: str, lower, upper, by: Sequence[str] = ()) -> DataFrame:
    """Coverage and mean interval length inside and outside [-1, 1]."""
    return df.withColumn("region", region(x)).groupBy(*by, "region").agg(
        coverage(y, lower, upper).alias("coverage"), mean_width(lower, upper).alias("length")
    )
