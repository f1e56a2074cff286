"""Per-row lookups in small sorted arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bin_of(x, edges) -> Column:
    """1-based bin (edge[b-1], edge[b]]; the first bin also holds its left edge. Outside gives null."""
    x, edges = _c(x), _c(edges)
    below = F.size(F.filter(edges, lambda e: e < x))
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(below, F.lit(1)))


def interpolate(x, breakpoints: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise-linear through (breakpoint, value), constant beyond the ends."""
    x = _c(x)
    result = F.when(x <= F.lit(float(breakpoints[0])), F.lit(float(values[0])))
    for (x0, y0), (x1, y1) in zip(
        zip(breakpoints, values, strict=True), list(zip(breakpoints, values, strict=True))[1:], strict=False
    ):
        slope = (float(y1) - float(y0)) / (float(x1) - float(x0))
        result = result.when(x <= F.lit(float(x1)), F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope))
    return result.otherwise(F.lit(float(values[-1])))


def probability_transform(y, quantiles, levels: Sequence[float]) -> Column:
    """PIT of y in a non-decreasing quantile array: interpolated level, exactly 0 or 1 outside the array."""
    y, q = _c(y), _c(quantiles)
    # written out level by level, which Spark compiles; functions of arrays it would interpret for every row
    out = F.when(y <= F.element_at(q, 1), F.lit(0.0)).when(y >= F.element_at(q, -1), F.lit(1.0))
    for i in range(1, len(levels)):
        a0, a1, q0, q1 = float(levels[i - 1]), float(levels[i]), F.get(q, i - 1), F.get(q, i)
        out = out.when(y <= q1, F.lit(a0) + F.lit(a1 - a0) * (y - q0) / (q1 - q0))
    return out


def quantile_score(y, quantiles, levels: Sequence[float]) -> Column:
    """CRPS approximated on a level grid: twice the mean level step times the summed pinball loss."""
    y, q = _c(y), _c(quantiles)
    step = (float(levels[-1]) - float(levels[0])) / (len(levels) - 1)
    losses = [F.greatest(F.lit(float(a)) * (y - F.get(q, i)), F.lit(float(a) - 1.0) * (y - F.get(q, i))) for i, a in enumerate(levels)]
    return F.lit(2.0 * step) * sum(losses, F.lit(0.0))


def bilinear(x, y, grid: Sequence[Sequence[float]]) -> Column:
    """Bilinear blend of grid[i][j], given at integer points (i, j), in the cell of (x, y).

    The cell index is clipped to the grid, so points outside continue the border cell.
    """
    x, y = _c(x), _c(y)
    rows, columns = len(grid), len(grid[0])
    flat = literal_array([v for row in grid for v in row])
    i = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(rows - 2)).cast("int")
    j = F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(columns - 2)).cast("int")
    at = lambda di, dj: F.get(flat, (i + di) * columns + (j + dj))
    s, t = x - i, y - j
    return (
        (1.0 - s) * (1.0 - t) * at(0, 0) + s * (1.0 - t) * at(1, 0) + (1.0 - s) * t * at(0, 1) + s * t * at(1, 1)
    )
