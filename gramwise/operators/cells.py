"""Cells: which groups of reference rows can matter to a query row.

In a table held by a task every row belongs to the cell of a near pivot, and a cell knows its radius and its rows: it lies
at least ``distance to its pivot - radius`` away. Pivots number about the square root of the rows.

A larger table is cut into leaves of bounded size by medians of a sample, and a leaf knows the box around its rows. A row
finds its leaf in as many steps as the tree is deep, and query rows of one leaf look at the other leaves together.

Rows of few coordinates that are held together, a leaf or a small table, lie in buckets of such a tree of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MOST_LEAVES = 1 << 15
BUCKET_ROWS = 24
_SEARCH_ROWS = 512
"""Query rows of neighbouring buckets that look at the buckets around them together."""
_SEARCH_PAIRS = 1_000_000
_EPS = float(np.finfo(float).eps)


def usable(vector: str) -> Column:
    """Whether an array column has only finite components."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def squared_bounds(a: np.ndarray, b: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of a to all rows of b by one matrix product, and the most they may be off.

    Both sides are shifted by ``centre``; the closer that lies, the smaller the possible error.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = a - centre, b - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        d = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
        slack = 4.0 * (a.shape[1] + 4) * _EPS * (aa[:, None] + bb[None, :])
    # overflow leaves distances unknown: nothing is excluded by them
    unknown = ~np.isfinite(d) | ~np.isfinite(slack)
    if unknown.any():
        d[unknown], slack[unknown] = 0.0, np.inf
    return np.maximum(d, 0.0), slack


def exact_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows by differences, which keep their digits however far the rows lie from zero."""
    with np.errstate(over="ignore"):
        gap = a - b
        return (gap * gap).sum(axis=1)


@dataclass
class Cells:
    """Pivots with the radius of each cell, its rows, and the rows it has beyond its most frequent mask value."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    safe: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, exact distance to its pivot) of every row."""
        cell, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        step = max(1, 2_000_000 // max(1, len(self.pivots)))
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            d, _ = squared_bounds(part, self.pivots, self.pivots.mean(axis=0))
            cell[at : at + step] = d.argmin(axis=1)
            far[at : at + step] = np.sqrt(exact_squares(part, self.pivots[cell[at : at + step]]))
        return cell, far

    def floors(self, vectors: np.ndarray) -> np.ndarray:
        """A distance below which no row of the cell lies, for every vector and cell; empty cells are infinitely far."""
        d, slack = squared_bounds(vectors, self.pivots, self.pivots.mean(axis=0))
        floor = np.maximum(np.sqrt(np.maximum(d - slack, 0.0)) * (1 - 1e-12) - self.radius * (1 + 1e-12), 0.0)
        floor[:, self.rows == 0] = np.inf
        return floor

    def first_visits(self, vectors: np.ndarray, need: int) -> np.ndarray:
        """Cells, nearest pivots first, that together surely hold ``need`` rows a query may use; all where they don't."""
        d, _ = squared_bounds(vectors, self.pivots, self.pivots.mean(axis=0))
        d[:, self.rows == 0] = np.inf
        chosen, open_rows = np.zeros(d.shape, bool), np.arange(len(d))
        width = 4
        while len(open_rows):
            width = min(width, d.shape[1])
            part = d[open_rows]
            near = np.argpartition(part, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(width), part.shape)
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(part, near, axis=1), axis=1, kind="stable"), axis=1)
            held = np.cumsum(self.safe[near], axis=1)
            before = held - self.safe[near]
            enough = held[:, -1] >= need
            if width == d.shape[1]:
                enough[:] = True
            rows, places = np.nonzero((before < need) & enough[:, None])
            chosen[open_rows[rows], near[rows, places]] = True
            open_rows, width = open_rows[~enough], width * 8
        chosen[:, self.rows == 0] = False
        return chosen

    def later_visits(self, vectors: np.ndarray, reach: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """The other cells that can hold a row within ``reach`` (a rounded squared distance) of the query."""
        limit = np.sqrt(reach + 2e-9) * (1 + 1e-9)
        return (self.floors(vectors) <= limit[:, None]) & ~visited & (self.rows > 0)


@dataclass
class Leaves:
    """A tree of cuts with the box around the rows of every leaf, their number, and the rows beyond the most frequent mask."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    safe: np.ndarray

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        for _ in range(int(np.log2(len(self.axis) + 1))):
            node = 2 * node + 1 + (vectors[every, self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def _squares(self, low: np.ndarray, high: np.ndarray, leaves: np.ndarray, farthest: bool = False) -> np.ndarray:
        """Squared distances of boxes (or points) to leaves: of their nearest points, or of those furthest apart."""
        out = np.zeros((len(low), len(leaves)))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(low.shape[1]):
                over, under = self.low[leaves, i][None, :] - high[:, i][:, None], low[:, i][:, None] - self.high[leaves, i][None, :]
                gap = np.maximum(-over, -under) if farthest else np.maximum(np.maximum(over, under), 0.0)
                out += gap * gap
        # overflow leaves distances unknown: nothing is excluded by them
        out[~np.isfinite(out)] = np.inf if farthest else 0.0
        return out

    def pairs(self, vectors: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves that can hold a row within the distance ``limit`` of the vector, row by row."""
        if not len(vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        widest = np.array([limit.max()])
        box = self._squares(vectors.min(axis=0)[None, :], vectors.max(axis=0)[None, :], np.arange(len(self.rows)))[0]
        near = np.flatnonzero((np.sqrt(box) * (1 - 1e-12) <= widest) & (self.rows > 0))
        found = []
        for s in slices(len(vectors), max(1, len(near))):
            d = np.sqrt(self._squares(vectors[s], vectors[s], near)) * (1 - 1e-12)
            rows, cells = np.nonzero(d <= limit[s][:, None])
            found.append((rows + s.start, near[cells]))
        rows, cells = zip(*found, strict=True)
        return np.concatenate(rows), np.concatenate(cells)

    def within(self, vectors: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
        """Row by row the leaves that can hold a row within the distance ``limit`` of the vector."""
        rows, cells = self.pairs(vectors, limit)
        ends = np.searchsorted(rows, np.arange(len(vectors) + 1)).tolist()
        return [cells[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def surely(self, vectors: np.ndarray, need: int) -> np.ndarray:
        """A squared distance within which every vector has ``need`` rows it may use; infinite where there are too few."""
        out = np.full(len(vectors), np.inf)
        every = np.flatnonzero(self.safe > 0)
        if self.safe.sum() < need:
            return out
        for s in slices(len(vectors), len(every)):
            d = self._squares(vectors[s], vectors[s], every, farthest=True)
            order = np.argsort(d, axis=1)
            enough = (np.cumsum(self.safe[every][order], axis=1) >= need).argmax(axis=1)
            out[s] = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), enough] * (1 + 1e-12)
        return out


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians along the widest axis, node by node; a node without two different rows sends all to its first side."""
    nodes = 2**depth - 1
    axis, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
    held: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    for node in range(nodes):
        own = held.pop(node)
        rows, left = sample[own], np.ones(len(own), bool)
        if len(own) > 1:
            with np.errstate(over="ignore"):
                spread = rows.max(axis=0) - rows.min(axis=0)
            i = int(spread.argmax())
            if spread[i] > 0:
                values = np.sort(rows[:, i])
                middle = values[(len(values) - 1) // 2]
                # the largest row is never on the first side, so both sides hold rows
                axis[node], cut[node] = i, middle if middle < values[-1] else values[values < values[-1]][-1]
                left = rows[:, i] <= cut[node]
        held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
    return axis, cut


@dataclass
class Buckets:
    """Reference rows in the buckets of a tree, with the boxes of the buckets and of all nodes above them.

    ``levels`` holds (low, high, rows beyond the most frequent mask) of the nodes of every level, buckets first.
    """

    tree: Leaves
    starts: np.ndarray
    rows: dict[str, np.ndarray]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def search(self, q: dict, k: int, need: int, masked: bool, skip_same_key: bool, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rounded squared distances, numbers of the reference rows, rows compared with): the k nearest rows, nearest first.

        -1 stands for no row. Ties go to the smaller key. With ``reach`` only rows within these squared distances count.
        """
        n = len(q["id"])
        dist, at, compared = np.full((n, k), np.inf), np.full((n, k), -1), np.zeros(n, np.int64)
        if not n or not len(self.rows["rid"]):
            return dist, at, compared
        home = self.tree.leaf(q["v"])
        order = np.argsort(home, kind="stable")
        step = max(1, min(_SEARCH_ROWS, _SEARCH_PAIRS // int(self.tree.rows.max())))
        for first in range(0, n, step):
            own = order[first : first + step]
            some = {name: values[own] for name, values in q.items()}
            limit, i, j, met = self._at_home(some, home[own], k, need, masked, skip_same_key)
            if reach is not None:
                limit = np.minimum(limit, reach[own])
            limit = limit * (1 + 1e-12) + 2e-9
            rows, cells = self.tree.pairs(some["v"], np.sqrt(limit) * (1 + 1e-9))
            away = cells != home[own][rows]
            rows, cells = rows[away], cells[away]
            found_i, found_j = [i], [j]
            sizes = self.tree.rows[cells]
            through = np.cumsum(sizes)
            cuts = np.searchsorted(through, np.arange(_SEARCH_PAIRS, through[-1], _SEARCH_PAIRS)) + 1 if len(through) else []
            for part in np.split(np.arange(len(cells)), cuts):
                c = sizes[part]
                i = np.repeat(rows[part], c)
                j = np.repeat(self.starts[cells[part]] - (np.cumsum(c) - c), c) + np.arange(len(i))
                kept = self._squares(some["v"][i], j) <= limit[i]
                i, j = i[kept], j[kept]
                kept = ~self._barred(some, i, j, masked, skip_same_key)
                found_i.append(i[kept])
                found_j.append(j[kept])
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            d = self._squares(some["v"][i], j)
            kept = d <= limit[i]
            i, j, d = i[kept], j[kept], np.round(d[kept], 9)
            # rows of the reference are numbered by key within a bucket only
            by = np.lexsort((self.rows["rid"][j], d, i))
            i, j, d = i[by], j[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = place < k
            dist[own[i[kept]], place[kept]], at[own[i[kept]], place[kept]] = d[kept], j[kept]
            compared[own] = met + np.bincount(rows, weights=sizes, minlength=len(own)).astype(np.int64)
        return dist, at, compared

    def _squares(self, vectors: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = np.zeros(len(j))
        with np.errstate(over="ignore"):
            for c in range(vectors.shape[1]):
                gap = vectors[:, c] - self.rows["v"][j, c]
                gap *= gap
                d += gap
        return d

    def _barred(self, q: dict, i: np.ndarray, j: np.ndarray, masked: bool, skip_same_key: bool) -> np.ndarray:
        barred = np.zeros(len(i), bool)
        if masked:
            barred |= q["mask"][i] == self.rows["mask"][j]
        if skip_same_key:
            barred |= q["id"][i] == self.rows["rid"][j]
        return barred

    def _at_home(self, q: dict, home: np.ndarray, k: int, need: int, masked: bool, skip_same_key: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(squared distances that hold k rows, rows met in the own bucket as query and reference row, rows compared with)."""
        n, sizes = len(home), self.tree.rows[home]
        i = np.repeat(np.arange(n), sizes)
        column = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        j = self.starts[home][i] + column
        d = np.full((n, max(k, int(sizes.max()))), np.inf)
        kept = ~self._barred(q, i, j, masked, skip_same_key)
        i, j = i[kept], j[kept]
        d[i, column[kept]] = self._squares(q["v"][i], j)
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        # where the bucket holds too few rows, the box of a node above it that surely holds enough
        few, node = np.flatnonzero(~np.isfinite(limit)), home
        for low, high, safe in self.levels:
            if not len(few):
                break
            enough = safe[node[few]] >= need
            done = few[enough]
            if len(done):
                with np.errstate(over="ignore", invalid="ignore"):
                    far = np.maximum(np.abs(q["v"][done] - low[node[done]]), np.abs(q["v"][done] - high[node[done]]))
                    limit[done] = (far * far).sum(axis=1) * (1 + 1e-12)
            few, node = few[~enough], node >> 1
        limit[np.isnan(limit)] = np.inf
        kept = d[i, column[kept]] <= limit[i] * (1 + 1e-12) + 2e-9
        return limit, i[kept], j[kept], sizes


def bucketed(rows: dict[str, np.ndarray], masked: bool) -> Buckets:
    """The rows (``rid``, ``v``, ``mask`` and others) in buckets of about ``BUCKET_ROWS``."""
    n, width = rows["v"].shape
    depth = int(np.ceil(np.log2(max(1.0, n / BUCKET_ROWS))))
    axis, cut = _cuts(rows["v"], depth)
    count = np.zeros(2**depth, np.int64)
    tree = Leaves(axis, cut, np.full((2**depth, width), np.inf), np.full((2**depth, width), -np.inf), count, count)
    cell = tree.leaf(rows["v"])
    order = np.lexsort((rows["rid"], cell))
    rows, cell = {name: values[order] for name, values in rows.items()}, cell[order]
    tree.rows = np.bincount(cell, minlength=2**depth)
    starts = np.concatenate(([0], np.cumsum(tree.rows)))[:-1]
    held = np.flatnonzero(tree.rows)
    if len(held):
        tree.low[held], tree.high[held] = np.minimum.reduceat(rows["v"], starts[held]), np.maximum.reduceat(rows["v"], starts[held])
    levels, low, high, total = [], tree.low, tree.high, tree.rows
    for level in range(depth + 1):
        most = np.zeros(len(total), np.int64)
        if masked and n:
            keys = np.stack([cell >> level, rows["mask"]])
            by = np.lexsort(keys[::-1])
            fresh = np.flatnonzero(np.concatenate(([True], (keys[:, by[1:]] != keys[:, by[:-1]]).any(axis=0))))
            np.maximum.at(most, keys[0, by[fresh]], np.diff([*fresh, n]))
        levels.append((low, high, total - most))
        if level < depth:
            low, high, total = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]
    tree.safe = levels[0][2]
    return Buckets(tree, starts, rows, levels)


def leaf_cells(reference: DataFrame, vector: str, key: str, width: int, mask: str | None, count: int, leaf_rows: int) -> tuple[Leaves, DataFrame]:
    """(the index, the reference with a column ``cell``) of a table whose rows all have usable vectors.

    Cuts come from a hash sample of 16 rows a leaf; leaves hold about ``leaf_rows`` rows, so they grow in number, not in
    size, up to ``MOST_LEAVES``.
    """
    depth = int(np.ceil(np.log2(max(1.0, min(MOST_LEAVES, count / leaf_rows)))))
    wanted = max(1000, 16 * 2**depth)
    drawn = reference.where(F.pmod(F.xxhash64(key, F.lit("leaf")), F.lit(max(1, count))) < wanted).select(vector).toPandas()[vector]
    sample = np.stack(drawn.to_numpy()).astype(float) if len(drawn) else np.zeros((0, width))
    axis, cut = _cuts(sample, depth)
    none = np.zeros(2**depth, np.int64)
    bare = Leaves(axis, cut, np.full((2**depth, width), np.inf), np.full((2**depth, width), -np.inf), none, none)
    shared = reference.sparkSession.sparkContext.broadcast(bare)
    placed = reference.withColumn("cell", leaf_of(shared, width)(vector))
    by = F.col(mask).cast("long") if mask else F.lit(0).cast("long")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf.sort_values(["cell", "m"], kind="stable")
                keys, v = pdf[["cell", "m"]].to_numpy(np.int64), np.stack(pdf[vector].to_numpy()).astype(float)
                starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
                low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
                yield pd.DataFrame({"cell": keys[starts, 0], "m": keys[starts, 1], "n": np.diff([*starts, len(v)]), "low": list(low), "high": list(high)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.groupby("m")["n"].sum()
        low, high = np.stack(pdf["low"].to_numpy()).min(axis=0), np.stack(pdf["high"].to_numpy()).max(axis=0)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "n": [n.sum()], "most": [n.max()], "low": [low], "high": [high]})

    parts = placed.select("cell", by.alias("m"), vector).mapInPandas(boxes, "cell int, m long, n long, low array<double>, high array<double>")
    found = parts.groupBy("cell").applyInPandas(merge, "cell int, n long, most long, low array<double>, high array<double>").toPandas()
    full = Leaves(axis, cut, bare.low.copy(), bare.high.copy(), none.copy(), none.copy())
    at = found["cell"].to_numpy(np.int64)
    full.rows[at] = found["n"]
    full.safe[at] = found["n"] - found["most"] if mask else found["n"]
    if len(at):
        full.low[at], full.high[at] = np.stack(found["low"].to_numpy()), np.stack(found["high"].to_numpy())
    return full, placed


def leaf_of(shared, width: int):
    """The leaf of a usable vector as a column function."""

    @F.arrow_udf("int")
    def leaf(vectors: pa.Array) -> pa.Array:
        return pa.array(shared.value.leaf(arrow_matrix(vectors, width)).astype(np.int32))

    return leaf


def arrow_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a missing vector or one of another length becomes NaN."""
    usual = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
    flat = (vectors if usual.all() else vectors.filter(pa.array(usual))).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(int(usual.sum()), width)
    if usual.all():
        return values
    out = np.full((len(usual), width), np.nan)
    out[usual] = values
    return out


def slices(n: int, cells: int) -> Iterator[slice]:
    """Query rows in slices whose table of distances to all pivots stays small."""
    step = max(1, 2_000_000 // max(1, cells))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))
