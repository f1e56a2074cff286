"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.llm.components import connected_components, forest_edges, local_forest
from gramwise.session import settle

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BLOCK = 1 << 20


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority vote of the XXH64 bits of all word shingles of the whole text; 0 without words."""
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(tokens) - size + 1
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(at + _BLOCK, n)].tolist(), ends[at + size - 1 : min(at + _BLOCK, n) + size - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
        lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(lanes[:, k], minlength=256) @ _BITS
    return int(sum(1 << k for k in range(64) if 2 * counts[k] > n))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long): the unsigned 64 bits of ``fingerprint`` as a signed long."""

    def each(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, words, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": prints.view(np.int64)})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(each, "doc_id long, fp long")


def hex_digits(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cells(parts: int) -> Column:
    """The population counts of ``parts`` equal pieces of the fingerprint."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1)
    return F.array(*[F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(mask)) for k in range(parts)])


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the count differences with a sum of at most ``radius``: zero, and one of each opposite pair."""
    reach = range(-radius, radius + 1)
    out, partial = [], [()]
    for _ in range(parts):
        partial = [(*p, d) for p, d in product(partial, reach) if sum(map(abs, p)) + abs(d) <= radius]
    for p in partial:
        first = next((d for d in p if d), 0)
        if first >= 0:
            out.append(p)
    return out


def _linked(a: np.ndarray, b: np.ndarray, radius: int):
    """Positions in blocks whose fingerprints differ in at most ``radius`` bits."""
    step = max(1, _BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            yield i + at, j


def near_links(prints: DataFrame, radius: int = 4, tile_rows: int = 16384) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints within ``radius`` bits; ``prints``: (fp, rep), each fp once.

    Fingerprints are cut into tiles by the population counts of their halves (of more pieces in larger tables, which
    only changes how much is skipped): two fingerprints within the radius have counts that differ by no more in sum, so
    all other tile pairs are skipped. A cell with many rows is split into several tiles. Inside a pair numpy compares
    all fingerprints, and a spanning forest of the links found is returned, not the pairs.
    """
    n = prints.count()
    parts = 2 if n < 1 << 20 else 4 if n < 1 << 27 else 8
    cells = prints.select("fp", "rep", _cells(parts).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).alias("splits"))
    tiles = settle(
        cells.join(sizes, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("splits")).alias("split"))
        .agg(F.collect_list(F.struct("fp", "rep")).alias("rows"))
        .select("cell", "split", F.col("rows.fp").alias("fps"), F.col("rows.rep").alias("reps"))
    )
    steps = F.array(*[F.array(*map(F.lit, o)) for o in _offsets(parts, radius)])
    left = tiles.select(
        "fps", "reps", F.col("split").alias("from"), F.col("cell").alias("home"), F.explode(F.transform(steps, lambda o: F.zip_with("cell", o, lambda x, d: x + d))).alias("cell")
    )
    right = tiles.select("cell", "split", F.col("fps").alias("fps2"), F.col("reps").alias("reps2"))
    pairs = left.join(right, "cell").where((F.col("home") != F.col("cell")) | (F.col("from") <= F.col("split")))

    def compare(batches):
        for batch in batches:
            for fps, reps, fps2, reps2, same in batch.itertuples(index=False):
                a, b, ids = np.asarray(fps, np.int64).view(np.uint64), np.asarray(fps2, np.int64).view(np.uint64), np.asarray(reps, np.int64)
                shift = 0 if same else len(a)
                if not same:
                    ids = np.concatenate((ids, np.asarray(reps2, np.int64)))
                labels = np.arange(len(ids))
                for i, j in _linked(a, b, radius):
                    local_forest(labels, i, j + shift)
                hung = forest_edges(labels)
                if len(hung):
                    yield pd.DataFrame({"u": ids[hung], "v": ids[labels[hung]]})

    same = ((F.col("home") == F.col("cell")) & (F.col("from") == F.col("split"))).alias("same")
    return pairs.select("fps", "reps", "fps2", "reps2", same).mapInPandas(compare, "u long, v long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every row: groups of texts linked by near fingerprints.

    component_id is the smallest doc_id that can be reached by links between fingerprints at most ``radius`` bits
    apart; equal fingerprints always link. A null or wordless text has fingerprint zero and links like any other. A
    row without doc_id has a fingerprint but a null component. Repeated rows come back as often as they came. Only
    ids and fingerprints are shuffled; copies collapse to one fingerprint before anything is compared.
    """
    prints = settle(fingerprints(docs, key, text, words, seed))
    classes = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    components = connected_components(near_links(classes, radius))
    named = classes.join(components, classes.rep == components.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", hex_digits("fp").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )
