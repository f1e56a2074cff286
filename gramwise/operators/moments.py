"""Weighted moments of a table and the small solves on them.

``moments`` is the one data pass behind every linear estimator. Its output row holds, per group,

* ``n``  the number of rows,
* ``g``  the Gram sums  sum(w z_i z_j), i <= j, row by row, with z = (1, x_1..x_p),
* ``b``  for every response r: sum(r z_i), responses one after another,
* ``rr`` for every pair of responses r <= s: sum(r s), when asked for.

The weight belongs to ``g`` only; a response carries its own weight (``w * y`` for least squares). Signed
weights are fine. Fits use the centred sums of ``gramwise.operators.centred``. A row with a null or NaN among its inputs, responses or weight is left out of every sum, and
``n`` does not count it: whatever the number of columns, the sums are those of the complete rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gramwise.operators.centred import centred_moments, centred_solve, others_moments
from gramwise.operators.ranks import attach
from gramwise.session import settle

EXPLICIT_SUMS = 150
"""Sums written out as aggregate expressions up to here; above, each Arrow batch is multiplied by NumPy."""


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def moments(
    df: DataFrame,
    xs: Sequence[str | Column],
    responses: Sequence[str | Column] = (),
    weight: str | Column | None = None,
    by: Sequence[str] = (),
    intercept: bool = True,
    cross: bool = False,
) -> DataFrame:
    """One aggregate: (by..., n, g, b, rr)."""
    z = ([F.lit(1.0)] if intercept else []) + [_c(x).cast("double") for x in xs]
    r = [_c(y).cast("double") for y in responses]
    w = None if weight is None else _c(weight).cast("double")
    k, m = len(z), len(r)
    # Name the inputs once, so that no expression is evaluated again inside every product.
    names = [f"__z{i}" for i in range(k)] + [f"__r{i}" for i in range(m)]
    flat = df.select(*by, *[c.alias(a) for c, a in zip(z + r, names, strict=True)], *([w.alias("__w")] if w is not None else []))
    used = names + (["__w"] if w is not None else [])
    sums = k * (k + 1) // 2 + k * m + (m * (m + 1) // 2 if cross else 0)
    if sums > EXPLICIT_SUMS:
        return _block_moments(flat, [F.col(a) for a in names[:k]], [F.col(a) for a in names[k:]], None if w is None else F.col("__w"), list(by), cross)
    complete = reduce(and_, [F.col(a).isNotNull() & ~F.isnan(a) for a in used], F.lit(True))
    flat = flat.withColumn("__ok", complete)
    flat = flat.select(*by, "__ok", *[F.when(F.col("__ok"), F.col(a)).otherwise(0.0).alias(a) for a in used])
    zc = [F.col(a) for a in names[:k]]
    rc = [F.col(a) for a in names[k:]]
    wz = [c if w is None else F.col("__w") * c for c in zc]
    g = [F.sum(wz[i] * zc[j]) for i in range(k) for j in range(i, k)]
    b = [F.sum(s * c) for s in rc for c in zc]
    rr = [F.sum(rc[i] * rc[j]) for i in range(m) for j in range(i, m)] if cross else []
    empty = F.array().cast("array<double>")
    return flat.groupBy(*by).agg(
        F.count_if("__ok").alias("n"),
        F.array(*g).alias("g"),
        (F.array(*b) if b else empty).alias("b"),
        (F.array(*rr) if rr else empty).alias("rr"),
    )


def _block_moments(df, z, r, w, by, cross) -> DataFrame:
    """The same sums for wide tables: a matrix product per Arrow batch, summed within the task, then once across tasks.

    Incomplete rows are told apart inside the batch, where that is one test of the whole matrix.
    """
    k, m = len(z), len(r)
    w = F.lit(1.0) if w is None else w
    known = [F.coalesce(c, F.lit(float("nan"))) for c in (*z, *r, w)]
    slim = df.select(*by, F.array(*known).alias("v"))
    upper = np.triu_indices(k)
    cross_upper = np.triu_indices(m)
    sizes = (len(upper[0]), k * m, len(cross_upper[0]) if cross else 0)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = [((), pdf)] if not by else pdf.groupby(by, sort=False, dropna=False)
            for key, part in groups:
                v = np.stack(part["v"].to_numpy())
                v = v[~np.isnan(v).any(axis=1)]
                zz, rm, wm = v[:, :k], v[:, k : k + m], v[:, k + m]
                vals = [np.array([float(len(v))]), (zz.T @ (zz * wm[:, None]))[upper], (rm.T @ zz).ravel()]
                if cross:
                    vals.append((rm.T @ rm)[cross_upper])
                vec = np.concatenate(vals)
                seen[key] = seen[key] + vec if key in seen else vec
        for key, vec in seen.items():
            out = {name: [value] * len(vec) for name, value in zip(by, key, strict=True)}
            yield pd.DataFrame({**out, "pos": np.arange(len(vec)), "val": vec})

    fields = [df.select(*by).schema[name] for name in by]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField("val", T.DoubleType())])
    sums = slim.mapInPandas(partial, schema).groupBy(*by, "pos").agg(F.sum("val").alias("val"))
    packed = sums.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda s: s["val"]).alias("v")
    )
    return packed.select(
        *by,
        F.get(F.col("v"), 0).cast("long").alias("n"),
        F.slice("v", 2, sizes[0]).alias("g"),
        F.slice("v", 2 + sizes[0], sizes[1]).alias("b"),
        F.slice("v", 2 + sizes[0] + sizes[1], sizes[2]).alias("rr"),
    )


def add_moments(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum moment rows over the dropped keys. The input has few rows, one per group already aggregated."""
    def total(name):
        return F.aggregate(
            F.collect_list(name),
            F.transform(F.get(F.collect_list(name), 0), lambda v: F.lit(0.0)),
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
        ).alias(name)

    return rows.groupBy(*by).agg(F.sum("n").alias("n"), total("g"), total("b"), total("rr"))


def symmetric(upper: Sequence[float], k: int | None = None) -> np.ndarray:
    """The full matrix of an upper triangle stored row by row."""
    upper = np.asarray(upper, dtype=float)
    k = int((np.sqrt(8 * len(upper) + 1) - 1) / 2) if k is None else k
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = upper
    return full + np.triu(full, 1).T


def solve_small(gram: np.ndarray, rhs: np.ndarray, ridge: float = 0.0) -> np.ndarray | None:
    """gram^-1 rhs after scaling to a unit diagonal; None when the matrix is singular."""
    gram = gram + ridge * np.eye(len(gram))
    scale = np.sqrt(np.abs(np.diag(gram)))
    if not np.all(np.isfinite(gram)) or np.any(scale == 0):
        return None
    scaled = gram / np.outer(scale, scale)
    if np.linalg.cond(scaled) > 1e13:
        return None
    right = (np.asarray(rhs, dtype=float).T / scale).T
    return (np.linalg.solve(scaled, right).T / scale).T


def pseudo_solve(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(matrix) @ rhs


def solved(rows: DataFrame, ridge: float = 0.0, response: int = 0) -> DataFrame:
    """Add ``theta`` (null if singular) and ``status`` to moment rows, centred or not; a small solve per row, on executors."""

    @F.pandas_udf("array<double>")
    def theta(g: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(upper, rhs, centre):
            if upper is None or rhs is None:
                return None
            gram = symmetric(upper)
            k = len(gram)
            right = np.asarray(rhs)[response * k : (response + 1) * k]
            fit = solve_small(gram, right, ridge) if centre is None else centred_solve(gram, right, centre, solve_small, ridge)
            return None if fit is None else fit.tolist()

        return pd.Series([one(*row) for row in zip(g, b, c, strict=True)])

    centre = F.col("centre") if "centre" in rows.columns else F.lit(None).cast("array<double>")
    out = rows.withColumn("theta", theta("g", "b", centre))
    return out.withColumn("status", F.when(F.col("theta").isNull(), "singular").otherwise("ok"))


def least_squares(
    df: DataFrame,
    xs: Sequence[str | Column],
    y: str | Column,
    weight: str | Column | None = None,
    by: Sequence[str] = (),
    ridge: float = 0.0,
) -> DataFrame:
    """Coefficients, intercept first: (by..., n, theta, status). Groups that cannot be fitted say 'singular'.

    Sums are centred: columns far from zero are fitted as they are.
    """
    response = _c(y) if weight is None else _c(weight) * _c(y)
    rows = centred_moments(df, xs, [response], weight, by)
    return solved(rows, ridge).select(*by, "n", "theta", "status")


def out_of_fold_moments(rows: DataFrame, fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Per fold, the moments of all other folds: total minus own, from rows already aggregated by fold."""
    by = list(by)
    total = add_moments(rows, by).select(*by, *[F.col(c).alias(f"__{c}") for c in ("n", "g", "b", "rr")])
    joined = rows.join(total, by) if by else rows.join(F.broadcast(total))
    less = lambda c: F.zip_with(F.col(f"__{c}"), F.col(c), lambda a, b: a - b).alias(c)
    return joined.select(*by, fold, (F.col("__n") - F.col("n")).alias("n"), less("g"), less("b"), less("rr"))


def out_of_fold_least_squares(
    df: DataFrame, xs: Sequence[str | Column], y: str | Column, fold: str, weight: str | Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., fold, n, theta, status), each fitted on the other folds; one pass over the data for all folds."""
    response = _c(y) if weight is None else _c(weight) * _c(y)
    rows = settle(centred_moments(df, xs, [response], weight, [*by, fold]))
    return solved(others_moments(rows, fold, len(xs), 1, by)).select(*by, fold, "n", "theta", "status")


def coefficient_rows(fits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Unfold ``theta`` to (..., idx, term, theta); the names do not include the intercept."""
    labels = F.array(*[F.lit(n) for n in ("intercept", *names)])
    keep = [c for c in fits.columns if c not in ("theta", "g", "b", "rr")]
    out = fits.select(*keep, F.posexplode("theta").alias("idx", "theta"))
    return out.select(*keep, "idx", F.get(labels, F.col("idx")).alias("term"), "theta")


def linear_score(theta: Sequence[float] | Column, xs: Sequence[str | Column]) -> Column:
    """intercept + sum(theta_j x_j); theta is a literal list or an array column."""
    at = (lambda i: F.get(theta, i)) if isinstance(theta, Column) else (lambda i: F.lit(float(theta[i])))
    total = at(0)
    for i, x in enumerate(xs, start=1):
        total = total + at(i) * _c(x)
    return total


def collected_theta(fits: DataFrame) -> list[float] | None:
    """Coefficients of a one-row fit, fetched once per frame."""
    if not hasattr(fits, "_gramwise_theta"):
        fits._gramwise_theta = fits.first()["theta"]
    return fits._gramwise_theta


def score_with(df: DataFrame, fits: DataFrame, xs: Sequence[str | Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the prediction of the fit that belongs to each row's group (null where the group has no fit)."""
    by = list(by)
    if not by:
        theta = collected_theta(fits)
        return df.withColumn(name, F.lit(None).cast("double") if theta is None else linear_score(theta, xs))
    table = settle(fits).select(*by, F.col("theta").alias("__theta"))
    joined = attach(df, table, by, "left")
    return joined.withColumn(name, linear_score(F.col("__theta"), xs)).drop("__theta")


def second_moment_rows(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Moment rows in long form: (row_term, col_term, value) = sum(w z_i z_j) / n for i <= j."""
    terms = ["intercept", *names]
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    labels = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return rows.select("n", F.posexplode("g").alias("i", "s")).select(
        F.get(labels, F.col("i"))["a"].alias("row_term"),
        F.get(labels, F.col("i"))["b"].alias("col_term"),
        (F.col("s") / F.col("n")).alias("value"),
    )


def covariance_rows(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sample covariances in long form: (by..., row_term, col_term, value), one pass of centred aggregates."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[F.struct(F.lit(a).alias("row_term"), F.lit(b).alias("col_term"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def collect_moments(rows: DataFrame, responses: int = 0) -> Mapping[str, np.ndarray]:
    """One moment row on the driver as matrices: n, gram (k x k), rhs (responses x k), cross (responses x responses)."""
    row = rows.first()
    gram = symmetric(row["g"])
    k = len(gram)
    rhs = np.asarray(row["b"], dtype=float).reshape(-1, k) if responses else np.zeros((0, k))
    cross = symmetric(row["rr"]) if row["rr"] else np.zeros((0, 0))
    return {"n": row["n"], "gram": gram, "rhs": rhs, "cross": cross}


def means(df: DataFrame, columns: Sequence[str | Column]) -> np.ndarray:
    """Column means in one pass."""
    row = df.agg(*[F.avg(_c(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([float(v) for v in row])


