"""Connected components of a link table, by alternating star steps; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gramwise.session import settle


def local_forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge links between positions into ``labels`` (each position's smallest known member), in place."""
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def forest_edges(labels: np.ndarray) -> np.ndarray:
    """Positions that hang below another one: at most one edge a position, whatever the number of links was."""
    return np.flatnonzero(labels != np.arange(len(labels)))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links(u, v)``: the smallest node reachable.

    Each round joins neighbours to their minimum twice (large and small star). Rows never outnumber the links, a
    node with very many neighbours is pre-aggregated for its minimum and its join partition may be split by adaptive
    execution. Links with a null end and loops say nothing; without links the result is empty.
    """
    edges = settle(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(below.union(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
