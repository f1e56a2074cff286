"""Second moments about a centre inside the data, merged pairwise.

Sums of products of columns far from zero (seconds since 1970, identifiers) lose the digits that tell rows apart. Here
every Arrow batch takes its sums about its own means, and two sums meet by moving both to their common mean: an exact
linear change of coordinates, for weights of any sign. Fits are made in centred coordinates; the intercept is moved back.

Rows: (by..., n, centre, g, b, rr) as in ``moments``, with z = (1, x - centre) in place of (1, x).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

_HELD_GROUPS = 1000
"""Groups whose sums a task keeps across batches; sums of more groups leave batch by batch."""


class _Sums:
    """State of some groups: rows n, centre c, and sums over (1, x - c): gram, responses, products of responses."""

    def __init__(self, n, centre, gram, rhs, cross):
        self.n, self.centre, self.gram, self.rhs, self.cross = n, centre, gram, rhs, cross

    def about(self, centre: np.ndarray) -> _Sums:
        """The same sums about other centres, group by group."""
        k = self.gram.shape[1]
        move = np.broadcast_to(np.eye(k), self.gram.shape).copy()
        move[:, 1:, 0] = self.centre - centre
        return _Sums(self.n, centre, move @ self.gram @ move.transpose(0, 2, 1), self.rhs @ move.transpose(0, 2, 1), self.cross)

    def added(self, codes: np.ndarray, groups: int) -> _Sums:
        """Sums of all states with the same code, about their common mean."""
        n = np.bincount(codes, self.n, groups)
        share = self.n / np.where(n[codes] > 0, n[codes], 1.0)
        centre = np.zeros((groups, self.centre.shape[1]))
        np.add.at(centre, codes, self.centre * share[:, None])
        moved = self.about(centre[codes])
        total = lambda x: _by_code(x, codes, groups)
        return _Sums(n, centre, total(moved.gram), total(moved.rhs), total(moved.cross))

    def flat(self) -> dict[str, list]:
        upper, pairs = np.triu_indices(self.gram.shape[1]), np.triu_indices(self.cross.shape[1])
        return {
            "n": self.n.astype(np.int64),
            "centre": list(self.centre),
            "g": list(self.gram[:, upper[0], upper[1]]),
            "b": list(self.rhs.reshape(len(self.n), -1)),
            "rr": list(self.cross[:, pairs[0], pairs[1]]),
        }

    @staticmethod
    def of_rows(frame: pd.DataFrame, k: int, m: int) -> _Sums:
        def stacked(name: str, width: int) -> np.ndarray:
            return np.array([np.asarray(v, float) for v in frame[name]]).reshape(len(frame), width)

        def full(name: str, size: int) -> np.ndarray:
            out, upper = np.zeros((len(frame), size, size)), np.triu_indices(size)
            out[:, upper[0], upper[1]] = stacked(name, len(upper[0]))
            out[:, upper[1], upper[0]] = out[:, upper[0], upper[1]]
            return out

        cross = full("rr", m) if len(frame) and len(frame["rr"].iloc[0]) else np.zeros((len(frame), 0, 0))
        return _Sums(frame["n"].to_numpy(float), stacked("centre", k - 1), full("g", k), stacked("b", k * m).reshape(len(frame), m, k), cross)


def _by_code(values: np.ndarray, codes: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros((groups, *values.shape[1:]))
    np.add.at(out, codes, values)
    return out


def _of_batch(v: np.ndarray, codes: np.ndarray, groups: int, k: int, m: int, cross: bool) -> _Sums:
    """Sums of one batch: columns x_1..x_(k-1), m responses, weight; rows with a NaN are left out."""
    sound = ~np.isnan(v).any(axis=1)
    v, codes = v[sound], codes[sound]
    x, r, w = v[:, : k - 1], v[:, k - 1 : k - 1 + m], v[:, -1]
    n = np.bincount(codes, minlength=groups).astype(float)
    centre = _by_code(x, codes, groups) / np.maximum(n, 1.0)[:, None]
    z = np.column_stack([np.ones(len(x)), x - centre[codes]])
    if groups == 1:
        gram, rhs = (z.T @ (z * w[:, None]))[None], (r.T @ z)[None]
        products = (r.T @ r)[None] if cross else np.zeros((1, 0, 0))
    else:
        gram, rhs = np.zeros((groups, k, k)), np.zeros((groups, m, k))
        products = np.zeros((groups, m, m) if cross else (groups, 0, 0))
        for i in range(k):
            for j in range(i, k):
                gram[:, i, j] = gram[:, j, i] = np.bincount(codes, w * z[:, i] * z[:, j], groups)
            for s in range(m):
                rhs[:, s, i] = np.bincount(codes, r[:, s] * z[:, i], groups)
        for i in range(m if cross else 0):
            for j in range(i, m):
                products[:, i, j] = products[:, j, i] = np.bincount(codes, r[:, i] * r[:, j], groups)
    return _Sums(n, centre, gram, rhs, products)


def _coded(frame: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """(group number of every row, the keys of the groups); null is a key like any other."""
    if not by:
        return np.zeros(len(frame), int), frame.iloc[:1][[]]
    codes = frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(codes, return_index=True)[1]
    return codes, frame[by].iloc[first].reset_index(drop=True)


def centred_moments(
    df: DataFrame,
    xs: Sequence[str | Column],
    responses: Sequence[str | Column] = (),
    weight: str | Column | None = None,
    by: Sequence[str] = (),
    cross: bool = False,
) -> DataFrame:
    """(by..., n, centre, g, b, rr): one pass, sums within tasks, then pairwise across tasks; intercept always included.

    A row with a null or NaN among its inputs, responses or weight is left out, as in ``moments``; a group of such rows
    only has n = 0.
    """
    by, k, m = list(by), len(xs) + 1, len(responses)
    given = lambda c: c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))
    names = [f"__v{i}" for i in range(k + m)]
    columns = [*map(given, xs), *map(given, responses), F.lit(1.0) if weight is None else given(weight)]
    slim = df.select(*by, *[c.cast("double").alias(a) for c, a in zip(columns, names, strict=True)])
    fields = [slim.schema[name] for name in by]
    numbers = [T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("centre", "g", "b", "rr")]]
    schema = T.StructType([*fields, *numbers])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: tuple[pd.DataFrame, _Sums] | None = None
        for frame in batches:
            if not len(frame):
                continue
            codes, keys = _coded(frame, by)
            sums = _of_batch(frame[names].to_numpy(float), codes, max(1, len(keys)), k, m, cross)
            if held is not None:
                keys = pd.concat([held[0], keys], ignore_index=True) if by else keys
                both = [np.concatenate(pair) for pair in zip((held[1].n, held[1].centre, held[1].gram, held[1].rhs, held[1].cross), (sums.n, sums.centre, sums.gram, sums.rhs, sums.cross), strict=True)]
                codes, keys = _coded(keys, by) if by else (np.zeros(2, int), keys)
                sums = _Sums(*both).added(codes, max(1, len(keys)))
            held = (keys, sums)
            if len(sums.n) > _HELD_GROUPS:
                yield keys.assign(**sums.flat())
                held = None
        if held is not None:
            yield held[0].assign(**held[1].flat()) if by else pd.DataFrame(held[1].flat())

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        codes, keys = _coded(frame, by)
        sums = _Sums.of_rows(frame, k, m).added(codes, max(1, len(keys)))
        return keys.assign(**sums.flat()) if by else pd.DataFrame(sums.flat())

    parts = slim.mapInPandas(partial, schema)
    buckets = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64(*by), F.lit(buckets)) if by else F.lit(0)
    if not by:
        # many tasks meet in two steps, so that no task takes in the sums of all
        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("__step")).applyInPandas(merge, schema)
    return parts.groupBy(place.alias("__place")).applyInPandas(merge, schema)


def centred_solve(gram: np.ndarray, rhs: np.ndarray, centre: np.ndarray, solve: Callable, ridge: float = 0.0) -> np.ndarray | None:
    """Coefficients for (1, x) from sums over (1, x - centre); a ridge penalises the coefficients for (1, x)."""
    back = np.eye(len(gram))
    back[0, 1:] = -np.asarray(centre, float)
    fit = solve(gram + ridge * back.T @ back, rhs)
    return None if fit is None else back @ fit


def others_moments(rows: DataFrame, fold: str, xs: int, responses: int, by: Sequence[str] = ()) -> DataFrame:
    """Per fold the centred moments of all other folds, added up, not subtracted: folds are few, and digits stay."""
    by, k = list(by), xs + 1

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in frame[fold].unique():
            own = frame[fold].isna() if pd.isna(f) else frame[fold] == f
            rest = frame[~own]
            if not len(rest):
                # no other fold: an empty sum, which no fit comes from
                rest = frame[own].assign(n=0, **{c: [[0.0] * len(v) for v in frame.loc[own, c]] for c in ("centre", "g", "b", "rr")})
            sums = _Sums.of_rows(rest, k, responses).added(np.zeros(len(rest), int), 1)
            out.append(frame[own].iloc[:1][[*by, fold]].reset_index(drop=True).assign(**sums.flat()))
        return pd.concat(out) if out else frame.iloc[:0]

    return rows.groupBy(*by).applyInPandas(merge, rows.select(*by, fold, "n", "centre", "g", "b", "rr").schema)
