"""Few rows are compared: buckets on few coordinates, series on a line."""

import numpy as np
import pandas as pd
import pytest

from gramwise.operators import neighbors as N
from gramwise.operators.cells import bucketed


@pytest.mark.parametrize("kind", ["even", "copies", "one mask for each region", "far"])
def test_buckets_equal_all_pairs_and_compare_few(kind):
    rng = np.random.default_rng(4)
    n, k = 6000, 4
    v, mask = rng.random((n, 2)), rng.integers(0, 4, n)
    if kind == "copies":
        v[:3000] = v[0]
    if kind == "one mask for each region":
        mask = (v[:, 0] * 4).astype(int)
    if kind == "far":
        v[0] = 1e200
    rows = {"rid": rng.permutation(n), "v": v, "mask": mask, "payload": np.zeros(n)}
    asked = {"id": rows["rid"][:300], "v": v[:300], "mask": mask[:300]}
    dist, at, compared = bucketed(rows, True).search(asked, k, k + 1, True, True)
    for i in range(300):
        with np.errstate(over="ignore"):
            d = np.round(((v[i] - v) ** 2).sum(axis=1), 9)
        allowed = np.flatnonzero((mask != mask[i]) & (rows["rid"] != rows["rid"][i]))
        best = allowed[np.lexsort((rows["rid"][allowed], d[allowed]))[:k]]
        held = bucketed(rows, True).rows["rid"][at[i]] if i < 3 else None
        assert dist[i].tolist() == d[best].tolist()
        assert held is None or held.tolist() == rows["rid"][best].tolist()
    if kind == "even":
        assert compared.mean() < 250


def test_series_on_one_coordinate_from_fewer_rows(spark, monkeypatch):
    """12,000 distinct values on a line are added up without pairs."""
    monkeypatch.setattr(N, "_hold", None)
    monkeypatch.setattr(N, "leaf_cells", None)
    rng = np.random.default_rng(6)
    x, y = rng.random(12_000) * 9, rng.normal(size=12_000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(12_000), "v": [[a] for a in x], "y": y}))
    out = {r["qid"]: r["smooth"][0] for r in N.kernel_smooth(df.where("id < 50"), df, "id", "id", "v", "y", [0.5]).collect()}
    kernel = np.exp(-((x[:50, None] - x[None, :]) ** 2) / 0.5) / np.sqrt(2 * np.pi)
    assert [out[q] for q in range(50)] == pytest.approx(((kernel @ y) / (kernel.sum(axis=1) + 1e-6)).tolist(), abs=1e-11)
