"""Approximate nearest neighbours by inner product: several shifted Hilbert orderings, windows merged and reranked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gramwise.llm.neardup_vectors import stacked, usable
from gramwise.session import settle

_SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers (``bits`` bits in each of its dimensions) on the Hilbert curve."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the coarser cells
        bit = np.int64(1) << level
        low = bit - 1
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
    for d in range(1, dims):  # Gray code across the dimensions
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | ((x[d] >> level) & 1)
    return key


class Orderings:
    """``curves`` orderings of projected directions: each projects with its own rotation and shifts its own grid.

    Vectors are lengthened to a common norm by one more coordinate, so that the largest inner product is the smallest
    angle; queries have 0 there.
    """

    def __init__(self, width: int, norm: float, curves: int, dims: int, bits: int) -> None:
        rng = np.random.default_rng(_SEED)
        self.norm, self.bits = norm, bits
        self.dims = min(dims, width + 1)
        self.maps = [np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, self.dims) for _ in range(curves)]
        self.spread = 3.0 / np.sqrt(width + 1)

    def keys(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """One row of keys a vector, one column a curve."""
        norms = np.linalg.norm(vectors, axis=1)
        if query:
            unit, rest = vectors / norms[:, None], np.zeros(len(vectors))
        else:
            unit = vectors / self.norm
            rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))
        full = np.column_stack([unit, rest])
        top = (1 << self.bits) - 1
        out = []
        for map_, shift in zip(self.maps, self.shifts, strict=True):
            place = (full @ map_ / self.spread + 1) / 2 * (top - 1) + shift
            out.append(hilbert_keys(np.clip(place, 0, top).astype(np.int64), self.bits))
        return np.column_stack(out) if len(vectors) else np.zeros((0, len(self.maps)), np.int64)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the same order for equal rows wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (queries * candidates).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def _slightly_below(values: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(values), values - 1e-9 * np.abs(values), values)


def _top(block: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k largest values and all equal to the last of them."""
    if block.shape[1] <= k:
        return np.ones_like(block, bool)
    return block >= _slightly_below(np.partition(block, block.shape[1] - k, axis=1)[:, [block.shape[1] - k]])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows; one that is no number (infinities of both signs) counts as the smallest."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ b.T
    return np.where(np.isnan(out), -np.inf, out)


def _exact_top(sample: np.ndarray, k: int):
    """For mapInPandas: the ``k`` best candidates of each sample row among a task's rows, with their keys."""

    def each(batches):
        held = [pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "keys": []})]
        for batch in batches:
            vec = stacked(batch["vec"])
            score = _products(sample[:, : vec.shape[1]], vec) if vec.shape[1] <= sample.shape[1] else _products(np.pad(sample, ((0, 0), (0, vec.shape[1] - sample.shape[1]))), vec)
            q, c = np.nonzero(_top(score, k))
            found = pd.DataFrame({"q": q, "score": score[q, c], "keys": batch["keys"].to_numpy()[c]})
            held = [pd.concat([*held, found]).sort_values("score", ascending=False).groupby("q").head(k)]
        yield held[0]

    return each


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", curves: int = 4, dims: int = 8, bits: int = 6,
    block_rows: int = 2048, most_blocks: int = 4096, sample: int = 64, target: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest found among all other rows.

    Every row gets a key on each of ``curves`` Hilbert orderings. Keys are cut at quantiles of all rows into ranges of
    about ``block_rows`` rows (at most ``most_blocks`` ranges; larger ones are split at random and searched in parts). A
    query searches its own range and a window of neighbouring ranges on every curve; the hits are merged and ranked by
    the exact inner product of the original vectors, ties by the smaller id. The window is fitted: the exact neighbours
    of up to ``sample`` queries (smallest key hash) among all rows are found by brute force, and the window is the
    smallest that holds ``target`` of them on at least one curve. Data in which near vectors are close on the curves get
    small windows; directions without any structure get windows of most ranges, as no ordering can separate them.

    Equal vectors are searched once; of a vector's ids the smallest k + 1 can appear among anyone's k nearest, so no
    others are carried along. Vectors that are null, zero or not finite, and rows without id, take no part; exactly
    repeated rows count once. Shorter vectors count as ending in zeros. A product that overflows is infinite and ranks so; one
    that is no number (infinities of both signs) counts as minus infinity.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, key, vector)
    asked = vectors.where(is_query & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    rows = settle(rows.distinct().join(asked.withColumn("asks", F.lit(True)), "id", "left").withColumns(
        {"asks": F.coalesce("asks", F.lit(False)), "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}
    ))
    shape = rows.agg(F.max(F.size("vec")).alias("width"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    if shape["width"] is None:
        return spark.createDataFrame([], schema)
    width = shape["width"]
    orders = spark.sparkContext.broadcast(Orderings(width, shape["norm"], curves, dims, bits))
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = (
        rows.withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= k + 1).groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("least_id"), F.first("vec").alias("vec"))
    )
    queries = rows.where("asks").select(F.col("id").alias("query_id"), "h1", "h2")

    def keyed(query: bool):
        def each(batches):
            for batch in batches:
                vec = stacked(batch["vec"])
                keys = orders.value.keys(np.pad(vec, ((0, 0), (0, width - vec.shape[1]))), query)
                yield batch.assign(keys=list(keys))

        return each

    found = settle(distinct.mapInPandas(keyed(False), "h1 long, h2 long, ids array<long>, least_id long, vec array<double>, keys array<long>"))
    searched = distinct.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    searched = settle(searched.mapInPandas(keyed(True), "h1 long, h2 long, ids array<long>, least_id long, vec array<double>, keys array<long>").drop("ids"))

    n = found.count()
    blocks = max(1, min(most_blocks, n // block_rows))
    shares = [b / blocks for b in range(1, blocks)]
    cuts = [[] for _ in range(curves)]
    if shares:
        cuts = found.agg(*[F.percentile_approx(F.col("keys")[c], shares, 100 * blocks).alias(f"c{c}") for c in range(curves)]).first()
    cuts = [np.array(c, np.int64) for c in cuts]

    # the window: how many ranges away the exact neighbours of the sample are on their best curve
    probe = searched.orderBy(F.xxhash64("h1", "h2", F.lit(3)), "h1", "h2").limit(sample).collect()
    window = 0
    if probe and blocks > 1:
        truth = found.select("vec", "keys").mapInPandas(_exact_top(stacked([r["vec"] for r in probe]), k), "q int, score double, keys array<long>")
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        hits = truth.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "keys").collect()
        own = np.array([[np.searchsorted(cuts[c], r["keys"][c]) for c in range(curves)] for r in probe])
        away = [min(abs(int(np.searchsorted(cuts[c], r["keys"][c])) - int(own[r["q"], c])) for c in range(curves)) for r in hits]
        window = int(np.ceil(np.quantile(away, target)))

    def ranged(batches):
        for batch in batches:
            keys = np.array(batch["keys"].tolist()).reshape(len(batch), curves)
            yield batch.drop(columns="keys").assign(at=list(np.column_stack([np.searchsorted(cuts[c], keys[:, c]) for c in range(curves)]).astype(np.int32)))

    fields = "h1 long, h2 long, least_id long, vec array<double>, at array<int>"
    placed = found.drop("ids").mapInPandas(ranged, fields)
    asking = searched.mapInPandas(ranged, fields)
    placed = placed.select("*", F.posexplode("at").alias("curve", "block"))
    splits = placed.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block_rows)).cast("int").alias("splits"))
    splits = settle(splits)  # at most curves x most_blocks rows
    placed = placed.join(F.broadcast(splits), ["curve", "block"]).withColumn("split", F.pmod(F.hash("h1", "h2"), F.col("splits"))).drop("splits")

    def visits(frame: DataFrame, first: bool) -> DataFrame:
        """One row for each range part that a query searches."""
        near = F.col("own") if first else None
        out = frame.select("*", F.posexplode("at").alias("curve", "own"))
        if first:
            out = out.withColumn("block", near)
        else:
            reach = F.sequence(F.greatest(F.col("own") - window, F.lit(0)), F.least(F.col("own") + window, F.lit(blocks - 1)))
            out = out.withColumn("block", F.explode(reach)).where("block <> own")
        out = out.join(F.broadcast(splits), ["curve", "block"])
        return out.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("own", "splits")

    fields = "q1 long, q2 long, h1 long, h2 long, least_id long, score double"

    def search(asked_rows: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        """The best of one range part for each query; what an earlier curve shows to it as well is left to that curve."""
        if not len(asked_rows) or not len(here):
            return pd.DataFrame({c.split()[0]: [] for c in fields.split(", ")})
        curve = int(here["curve"].iloc[0])
        vec, at = stacked(here["vec"]), np.array(here["at"].tolist()).reshape(len(here), curves)
        out = []
        for cut in range(0, len(asked_rows), 256):
            part = asked_rows.iloc[cut : cut + 256]
            q, q_at = stacked(part["vec"]), np.array(part["at"].tolist()).reshape(len(part), curves)
            wide = max(q.shape[1], vec.shape[1])
            q, v = np.pad(q, ((0, 0), (0, wide - q.shape[1]))), np.pad(vec, ((0, 0), (0, wide - vec.shape[1])))
            score, open_ = _products(q, v), np.ones((len(q), len(v)), bool)
            reach = part["reach"].to_numpy()[:, None]
            for c in range(curve):
                open_ &= np.abs(q_at[:, c][:, None] - at[None, :, c]) > reach
            floor = _slightly_below(part["floor"].to_numpy()[:, None])
            i, j = np.nonzero(_top(np.where(open_, score, -np.inf), k + 1) & open_ & (score >= floor))
            out.append(pd.DataFrame({
                "q1": part["h1"].to_numpy()[i], "q2": part["h2"].to_numpy()[i], "h1": here["h1"].to_numpy()[j], "h2": here["h2"].to_numpy()[j], "least_id": here["least_id"].to_numpy()[j], "score": _scores(q[i], v[j]),
            }))
        return pd.concat(out)

    parts = ["curve", "block", "split"]

    def searched_in(asks: DataFrame, first: bool, floor: Column, reach: int) -> DataFrame:
        seen = visits(asks.withColumns({"floor": floor, "reach": F.lit(reach)}), first)
        return seen.groupBy(*parts).cogroup(placed.groupBy(*parts)).applyInPandas(search, fields)

    def best_of(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least_id")
        return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")

    near = settle(best_of(searched_in(asking, True, F.lit(float("-inf")), 0)))
    if window:
        lowest = near.groupBy("q1", "q2").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        known = asking.join(lowest, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").drop("q1", "q2")
        floor = F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf")))
        more = searched_in(known, False, floor, window)
        near = best_of(near.union(more).dropDuplicates(["q1", "q2", "h1", "h2"]))
    answers = (
        near.join(found.select("h1", "h2", "ids"), ["h1", "h2"])
        .join(queries.select("query_id", F.col("h1").alias("q1"), F.col("h2").alias("q2")), ["q1", "q2"])
        .select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
