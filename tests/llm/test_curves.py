"""Neighbours against brute force: recall, exact scores, ties, copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramwise.llm import curves


def brute(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    vec = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = vec @ vec[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("bits,dims", [(2, 2), (3, 3), (4, 2)])
def test_keys_walk_through_neighbouring_cells(bits, dims):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block_rows", [64, 2048])
def test_recall_on_the_given_vectors(spark, block_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = found(curves.nearest_neighbours(df, F.col("vec_id") % 20 == 0, block_rows=block_rows))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, pairs in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in pairs if i in exact)


def test_structure_needs_small_windows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=12) * 0.1).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(curves.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5, block_rows=50)), brute(rows, 5)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 100)] + [(200, [0.0, 2.0]), (201, [0.5, 0.5])]
    odd = [(300, None), (320, [0.0, 0.0]), (340, [float("nan"), 1.0]), (360, [None, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, score double, rank int")
    got = found(curves.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert got == brute(rows)
    few = spark.createDataFrame(rows[98:], "vec_id long, embedding array<double>")
    assert found(curves.nearest_neighbours(few, F.col("vec_id") % 20 == 0)) == brute(rows[98:])
    assert curves.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_go_to_the_smaller_id_before_the_cut(spark):
    """58 different vectors with the same inner product: the cut must know ids, not only scores."""
    rows = [(20, [1.0] + [0.0] * 59)] + [(i, [1.0] + [float(j == i) for j in range(59)]) for i in range(1, 60) if i != 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(curves.nearest_neighbours(df, F.col("vec_id") == 20))
    assert [i for i, _ in got[20]] == [i for i in range(1, 22) if i != 20]


def test_products_that_overflow_rank_as_infinite(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [2e200, 5.0]), (3, [0.0, 1.0]), (4, [0.0, 3.0]), (5, [-1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(curves.nearest_neighbours(df, F.col("vec_id") == 0))
    assert got[0] == [(1, float("inf")), (2, float("inf")), (4, 3.0), (3, 1.0), (5, float("-inf"))]
