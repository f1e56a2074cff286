"""Sums of normal kernels over many rows of one or two coordinates, in time linear in the rows.

Space is cut into boxes about as wide as the kernel. The reference rows of a box leave their moments about its middle; a
Hermite series turns these into a power series about the middle of every box within the kernel's reach, one coordinate
after the other; query rows then evaluate the series of their own box. With ``TERMS`` powers a coordinate the series is
off by about 1e-14 of the weights nearby, as much as sums of doubles are. Box edges are multiples of a power of two, so
offsets within boxes and distances of boxes are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TERMS = 30
CHUNK = 64
"""Boxes along a coordinate that one task group turns into series."""

MOMENT_BYTES = 512 * 1024 * 1024

_EDGE = 4
"""Boxes along a coordinate whose query rows are evaluated together."""


@dataclass(frozen=True)
class Boxes:
    """The boxes of exp(-gamma * squared distance), used up to where it is exp(-exponent)."""

    gamma: float
    exponent: float

    @property
    def width(self) -> float:
        """The kernel's unit of length: exp(-gamma d) = exp(-d / (2 width^2))."""
        return 1.0 / np.sqrt(2.0 * self.gamma)

    @property
    def side(self) -> float:
        """A power of two, more than one and at most two units."""
        return float(2.0 ** (np.floor(np.log2(self.width)) + 1))

    @property
    def reach(self) -> int:
        return int(np.sqrt(2.0 * self.exponent) * self.width / self.side) + 2

    def number(self, coordinate: Column) -> Column:
        return F.floor(coordinate / F.lit(self.side)).cast("long")

    def powers(self, x: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Powers 0 to TERMS - 1 of the offsets from the box middles, in units."""
        u = (x - (box + 0.5) * self.side) / self.width
        return np.cumprod(np.column_stack([np.ones(len(u)), *[u] * (TERMS - 1)]), axis=1)

    def shifts(self) -> dict[int, np.ndarray]:
        """By the number of boxes from source to target: the matrix that turns moments into coefficients."""
        out = {}
        powers = np.arange(TERMS)
        down = 1.0 / _factorials()
        for j in range(-self.reach, self.reach + 1):
            x = j * self.side / self.width
            # derivatives of exp(-x^2 / 2) by the recurrence of Hermite polynomials
            d = [np.exp(-0.5 * x * x), -x * np.exp(-0.5 * x * x)]
            for n in range(1, 2 * TERMS - 1):
                d.append(-x * d[n] - n * d[n - 1])
            d = np.array(d)[powers[:, None] + powers[None, :]]
            out[j] = d * down[:, None] * np.where(powers % 2, -1.0, 1.0)[None, :]
        return out


def _factorials() -> np.ndarray:
    return np.cumprod(np.concatenate(([1.0], np.arange(1.0, TERMS))))


def fits(boxes: Sequence[Boxes], reference: DataFrame, rows: int, width: int, masks: Sequence[int]) -> bool:
    """Whether the moments of all boxes take at most MOMENT_BYTES, or eight times the room of the rows themselves."""
    if width not in (1, 2) or len(masks) > 16:
        return False
    axes = [F.get("rv", i) for i in range(width)]
    far = F.max(F.greatest(*[F.abs(a) for a in axes], F.lit(0.0)))
    seen = [F.approx_count_distinct(F.struct("mask", *[b.number(a) for a in axes])) for b in boxes]
    row = reference.agg(far.alias("far"), *[n.alias(f"n{i}") for i, n in enumerate(seen)]).first()
    near = all((row["far"] or 0.0) < b.side * 2.0**50 for b in boxes)
    room = max(8 * rows * (width + 5) * 8, MOMENT_BYTES)
    return near and all(row[f"n{i}"] * 2 * TERMS**width * 8 <= room for i in range(len(boxes)))


def _placed(df: DataFrame, vector: str, boxes: Boxes, width: int) -> DataFrame:
    y = F.get(vector, 1) if width == 2 else F.lit(0.5 * boxes.side)
    df = df.withColumns({"x": F.get(vector, 0), "y": y}).drop(vector)
    return df.withColumns({"a": boxes.number(F.col("x")), "b": boxes.number(F.col("y"))})


def _stack(moments: pd.Series, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(moments), float).reshape(len(moments), *shape)


def box_moments(reference: DataFrame, boxes: Boxes, width: int) -> DataFrame:
    """(mask, a, b, m): moments of payload and weight; a box comes once for every batch that holds rows of it."""
    rows = _placed(reference, "rv", boxes, width).select("mask", "b", "a", "x", "y", "payload", "weight", "rid")
    rows = rows.repartitionByRange("mask", "b", "a", "rid").sortWithinPartitions("mask", "b", "a")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = 1.0 / _factorials()
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[["mask", "b", "a"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            u = boxes.powers(pdf["x"].to_numpy(float), keys[:, 2]) * scale
            v = boxes.powers(pdf["y"].to_numpy(float), keys[:, 1]) * scale if width == 2 else np.ones((len(pdf), 1))
            found = []
            for at, end in zip(starts, [*starts[1:], len(pdf)], strict=True):
                both = [(u[at:end] * pdf[c].to_numpy(float)[at:end, None]).T @ v[at:end] for c in ("payload", "weight")]
                found.append(np.stack(both).tobytes())
            yield pd.DataFrame({"mask": keys[starts, 0], "b": keys[starts, 1], "a": keys[starts, 2], "m": found})

    return rows.mapInPandas(sums, "mask long, b long, a long, m binary")


def _spread(moments: DataFrame, along: str, across: str, boxes: Boxes, rows: int) -> DataFrame:
    """Series about all boxes within reach along one coordinate, the two coordinates swapped in ``m``."""
    reach = boxes.reach
    chunk = lambda j: F.floor((F.col(along) + j) / F.lit(float(CHUNK))).cast("long")
    near = moments.withColumn("chunk", F.explode(F.sequence(chunk(-reach), chunk(reach))))

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["chunk"].iloc[0]) * CHUNK
        place, which = np.unique(pdf[along].to_numpy(np.int64), return_inverse=True)
        given = _stack(pdf["m"], (2, TERMS, rows))
        m = np.zeros((len(place), *given.shape[1:]))
        np.add.at(m, which, given)
        out, hit = np.zeros((CHUNK, *given.shape[1:])), np.zeros(CHUNK, bool)
        for j, matrix in boxes.shifts().items():
            to = place + j - base
            inside = (to >= 0) & (to < CHUNK)
            if inside.any():
                out[to[inside]] += matrix @ m[inside]
                hit[to[inside]] = True
        to = np.flatnonzero(hit)
        series = [np.ascontiguousarray(out[t].swapaxes(1, 2)).tobytes() for t in to]
        return pd.DataFrame({"mask": pdf["mask"].iloc[0], across: pdf[across].iloc[0], along: base + to, "m": series})

    return near.groupBy("mask", across, "chunk").applyInPandas(shift, f"mask long, {across} long, {along} long, m binary")


def box_series(moments: DataFrame, boxes: Boxes, width: int, masks: Sequence[int] | None) -> DataFrame:
    """(mask, a, b, m): the series of every box for query rows of that mask, which leave out source rows of the same mask.

    A box may come in several rows, which add up.
    """
    out = _spread(moments, "a", "b", boxes, TERMS if width == 2 else 1)
    if masks is not None:
        others = F.filter(F.array(*[F.lit(int(v)).cast("long") for v in masks]), lambda v: v != F.col("mask"))
        out = out.withColumn("mask", F.explode(others))
    return _spread(out, "b", "a", boxes, TERMS) if width == 2 else out


def dealt_sides(q: DataFrame, series: DataFrame, boxes: Boxes, width: int) -> tuple[DataFrame, DataFrame]:
    """Query rows and series with the number of the square of boxes (``cell``) in which they meet."""
    cell = F.xxhash64("mask", F.floor(F.col("a") / _EDGE), F.floor(F.col("b") / _EDGE)).alias("cell")
    asked = _placed(q.withColumn("mask", F.col("mask").cast("long")), "qv", boxes, width)
    keys = F.xxhash64("mask", "a", "b").alias("rid")
    return asked.select("qid", "mask", "x", "y", "a", "b", cell), series.select("mask", "a", "b", "m", cell, keys)


def evaluate(asked: pd.DataFrame, series: pd.DataFrame, boxes: Boxes, width: int) -> np.ndarray:
    """(query row, payload or weight): the sums of the query rows of some boxes."""
    out = np.zeros((len(asked), 2))
    if not len(asked) or not len(series):
        return out
    given = _stack(series["m"], (2, TERMS if width == 2 else 1, TERMS))
    if width == 1:
        given = given.swapaxes(2, 3)
    names = ["mask", "a", "b"]
    rows_of = {key: list(at) for key, at in series.groupby(names, sort=False).indices.items()}
    for key, at in asked.groupby(names, sort=False).indices.items():
        if key not in rows_of:
            continue
        m = given[rows_of[key]].sum(axis=0)
        u = boxes.powers(asked["x"].to_numpy(float)[at], np.full(len(at), key[1]))
        v = boxes.powers(asked["y"].to_numpy(float)[at], np.full(len(at), key[2])) if width == 2 else np.ones((len(at), 1))
        for c in range(2):
            out[at, c] = ((u @ m[c]) * v).sum(axis=1)
    return out
