"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where the bounds leave a doubt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.llm.components import connected_components, forest_edges, local_forest
from gramwise.session import settle

_ROUNDING = 1e-9
"""Slack for the rounding of double products over vectors of some thousand components."""
_BLOCK = 1 << 22


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, vec array<double>) of the rows with an id whose vector is finite, not null and not zero; distinct rows.

    Vectors of several lengths are compared as if the shorter ones ended in zeros.
    """
    vec = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    return rows.where(_takes_part()).select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))


def _takes_part() -> Column:
    """Whether a row (id, vec) is compared at all; never null."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def stacked(column) -> np.ndarray:
    """Array cells as one matrix, shorter ones filled with zeros."""
    cells = [np.asarray(c, np.float64) for c in column]
    width = max(map(len, cells), default=0)
    out = np.zeros((len(cells), width))
    for k, c in enumerate(cells):
        out[k, : len(c)] = c
    return out


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: int8 codes, scale, length of what rounding lost, length of what it kept."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rebuilt = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - rebuilt, axis=1), np.linalg.norm(rebuilt, axis=1)


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class _Tile:
    """Rows of a tile: int8 codes with their bounds, and the unit vectors for pairs in doubt."""

    def __init__(self, ids: bytes, weights: bytes, codes: bytes, bounds: bytes, units: bytes) -> None:
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        n = len(self.ids)
        self.codes = np.frombuffer(codes, np.int8).reshape(n, -1)
        self.scale, self.lost, self.held = np.frombuffer(bounds, np.float64).reshape(3, n)
        self.units = np.frombuffer(units, np.float64).reshape(n, -1)


def _linked(a: _Tile, b: _Tile, threshold: float):
    """Blocks (i, j) of positions with cosine >= threshold."""
    width = max(a.codes.shape[1], b.codes.shape[1])
    right, units_a, units_b = _wide(b.codes, width).astype(np.float32).T, _wide(a.units, width), _wide(b.units, width)
    exact_in_float = 127 * 127 * width < 1 << 24
    kind = np.float32 if exact_in_float else np.float64
    right = right.astype(kind)
    step = max(1, _BLOCK // max(1, len(b.ids)))
    most_scale, most_lost, most_held = b.scale.max(), b.lost.max(), b.held.max()
    for at in range(0, len(a.ids), step):
        part = slice(at, at + step)
        tile = _wide(a.codes[part], width).astype(kind) @ right
        # |u.v - s_u s_v q_u.q_v| <= lost_u * held_v + lost_v, as u = s_u q_u + (lost part) and |u| = 1
        least = (threshold - _ROUNDING - most_lost - a.lost[part] * most_held) / (a.scale[part] * most_scale)
        i, j = np.nonzero((tile >= np.floor(least)[:, None].astype(kind)) if np.all(least > 0) else np.ones_like(tile, bool))
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            near = tile[x, y].astype(np.float64) * a.scale[at + x] * b.scale[y]
            slack = a.lost[at + x] * b.held[y] + b.lost[y] + _ROUNDING
            sure, possible = near - slack >= threshold, near + slack >= threshold
            open_ = np.flatnonzero(possible & ~sure)
            if len(open_):
                sure[open_] = np.einsum("ij,ij->i", units_a[at + x[open_]], units_b[y[open_]]) >= threshold
            if sure.any():
                yield at + x[sure], y[sure]


def _pack(batches, tile_rows: int):
    """Tiles of at most ``tile_rows`` rows, numbered within the task."""
    held, count, number = [], 0, 0

    def tile(rows: pd.DataFrame, number: int) -> pd.DataFrame:
        vec = stacked(rows["vec"])
        top = np.abs(vec).max(axis=1, keepdims=True)
        vec = vec / top
        unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        codes, *bounds = quantised(unit)
        return pd.DataFrame({
            "task": [TaskContext.get().partitionId()], "number": [number], "ids": [rows["rep"].to_numpy(np.int64).tobytes()],
            "weights": [rows["weight"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "bounds": [np.stack(bounds).tobytes()], "units": [unit.tobytes()],
        })

    for batch in batches:
        while count + len(batch) >= tile_rows:
            head, batch = batch.iloc[: tile_rows - count], batch.iloc[tile_rows - count :]
            yield tile(pd.concat([*held, head]), number)
            held, count, number = [], 0, number + 1
        if len(batch):
            held.append(batch)
            count += len(batch)
    if count:
        yield tile(pd.concat(held), number)


def vector_links(classes: DataFrame, threshold: float = 0.9, tile_rows: int = 8192, least_tiles: int = 8) -> DataFrame:
    """Facts (u, v, n) about all pairs of ``classes(rep, weight, vec)``: links of a spanning forest (v set), and for u the
    summed weights of the classes linked to it within one tile pair (n set).

    Every tile meets every other one once, in a ring: tile t takes the next half of the tiles. Tiles are rows of bounded
    size; pairs of vectors never become rows.
    """
    n = classes.count()
    size = max(1, min(tile_rows, -(-n // least_tiles)))
    parts = max(1, -(-n // size))
    raw = settle(
        classes.repartition(parts, "rep").mapInPandas(
            lambda batches: _pack(batches, size), "task int, number int, ids binary, weights binary, codes binary, bounds binary, units binary"
        )
    )
    order = raw.select("task", "number").collect()  # two integers a tile
    rank = {(r["task"], r["number"]): k for k, r in enumerate(sorted(order))}
    total = len(rank)
    if not total:
        return classes.sparkSession.createDataFrame([], "u long, v long, n long")
    names = classes.sparkSession.createDataFrame([(*k, v) for k, v in rank.items()], "task int, number int, tile int")
    tiles = raw.join(F.broadcast(names), ["task", "number"]).drop("task", "number")
    steps = F.sequence(F.lit(0), F.lit(total // 2))
    ring = tiles.withColumn("step", F.explode(steps))
    if total % 2 == 0:
        ring = ring.where((F.col("step") < total // 2) | (F.col("tile") < total // 2))
    left = ring.select(*[F.col(c).alias(f"{c}_a") for c in tiles.columns], ((F.col("tile") + F.col("step")) % total).alias("tile"))
    fields = ("ids", "weights", "codes", "bounds", "units")

    def compare(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                a = _Tile(*[getattr(row, f"{c}_a") for c in fields])
                same = row.same
                b = a if same else _Tile(*[getattr(row, c) for c in fields])
                ids = a.ids if same else np.concatenate((a.ids, b.ids))
                shift = 0 if same else len(a.ids)
                labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                for i, j in _linked(a, b, threshold):
                    if same:
                        i, j = i[i != j], j[i != j]
                    local_forest(labels, i, j + shift)
                    np.add.at(links, i, b.weights[j])
                    if not same:
                        np.add.at(links, j + shift, a.weights[i])
                hung, some = forest_edges(labels), np.flatnonzero(links)
                yield pd.DataFrame({
                    "u": np.concatenate((ids[hung], ids[some])),
                    "v": pd.Series([*ids[labels[hung]].tolist(), *[None] * len(some)], dtype="Int64"),
                    "n": pd.Series([*[None] * len(hung), *links[some].tolist()], dtype="Int64"),
                })

    pairs = left.join(tiles, "tile").select(*[c for f in fields for c in (f"{f}_a", f)], (F.col("tile_a") == F.col("tile")).alias("same"))
    return pairs.mapInPandas(compare, "u long, v long, n long")


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: groups of vectors linked by cosine >= threshold.

    Equal vectors collapse to one class before the comparison and count with their number. A vector that is null, zero
    or holds null or non-finite components links with nothing; a row without id has a null component. Exactly repeated
    rows (same id, same vector) count as one vector and come back once; different vectors of one id are rows of their own.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).distinct()
    good = settle(usable(rows, "id", "vec").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    classes = settle(
        good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    )
    facts = settle(vector_links(classes.select("rep", "weight", "vec"), threshold))
    counts = facts.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(facts.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    named = classes.select("h1", "h2", "rep", "weight").join(counts, "rep", "left").join(components, "rep", "left")
    found = good.select("id", "h1", "h2").join(
        named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), ["h1", "h2"]
    )
    bad = rows.where(~_takes_part()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.select("id", "n_links", "component_id").union(bad).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
