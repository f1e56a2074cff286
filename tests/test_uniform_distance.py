"""The distance to the uniform distribution ranks few values."""

import numpy as np
import pandas as pd
import pytest

from gramwise.operators import ranks as R


def test_distance_to_uniform_ranks_few_values(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(R, "prefix", lambda df, *a, prefix=R.prefix: ranked.append(df.count()) or prefix(df, *a))
    rng = np.random.default_rng(10)
    u = np.concatenate((rng.random(20_000), [0.0] * 40, [1.0] * 30, [-0.5, 1.5, 7.0, 8.0]))
    g = np.where(np.arange(len(u)) % 3 == 0, None, "a")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "u": u}))
    out = {r["g"]: (r["ks"], r["n"]) for r in R.uniform_ks(df, "u", ["g"]).collect()}
    for name in (None, "a"):
        x = np.sort(u[g == name])
        n = len(x)
        through, before = np.searchsorted(x, x, "right") / n, np.searchsorted(x, x, "left") / n
        assert out[name] == (pytest.approx(np.maximum(through - x, x - before).max(), abs=1e-15), n)
    assert ranked and sum(ranked) < 2000
