"""Nulls, NaN, null groups and large offsets in features, labels, scores and keys."""

import numpy as np
import pytest

from gramwise.operators import iterate, moments, neighbors, ranks
from gramwise.operators.semisup import _worst
from gramwise.plans import semisup_study


def test_incomplete_rows_are_left_out_whatever_the_width(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ [1.0, -1.0] + 0.01 * rng.normal(size=400)
    rows = [(float(a) if i % 4 else None, float(b) if i % 7 else float("nan"), float(c) if i % 11 else None) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    whole = [r for r in rows if None not in r and not np.isnan(r[1])]
    want = np.linalg.lstsq(np.column_stack([np.ones(len(whole)), [r[0] for r in whole], [r[1] for r in whole]]), [r[2] for r in whole], rcond=None)[0]
    for sums in (150, 1):
        monkeypatch.setattr(moments, "EXPLICIT_SUMS", sums)
        fit = moments.least_squares(df, ["x1", "x2"], "y").first()
        assert fit["status"] == "ok" and np.allclose(fit["theta"], want, atol=1e-9)
        assert moments.moments(df, ["x1", "x2"], ["y"]).first()["n"] == len(whole)


def test_order_statistics_know_no_nulls_and_keep_null_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("a", None), ("a", float("nan")), (None, 5.0), (None, 7.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r["g"]: list(r["q"]) for r in ranks.level_quantiles(df, "v", [0.5], ["g"]).collect()} == {"a": [2.0], None: [7.0]}
    edges = {(r["g"], r["value"]) for r in ranks.order_statistic_edges(df, "v", 2, ["g"]).collect()}
    assert edges == {("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)}  # rule: an integer (N-1)k/bins takes that rank
    assert {r["g"]: r["median"] for r in iterate.exact_median(df, "v", ["g"]).collect()} == {"a": 2.0, None: 7.0}


def test_auc_takes_labelled_rows_only(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.95), (None, 0.99), (1, None), (0, float("nan"))], "y int, s double")
    assert ranks.auc(df, "y", "s").first()["auc"] == pytest.approx(1.0)


def test_neighbours_far_from_the_origin(spark):
    query = spark.createDataFrame([(0, [1e8]), (1, [1e8 + 1])], "id long, v array<double>")
    reference = spark.createDataFrame([(10, [1e8 + 0.4], 1.0), (11, [1e8 + 0.9], 2.0)], "id long, v array<double>, p double")
    for size in (1 << 26, 0):
        got = neighbors.nearest_join(query, reference, 1, "id", "id", "v", "p", broadcast_bytes=size)
        assert {r["qid"]: r["neighbours"][0]["rid"] for r in got.collect()} == {0: 10, 1: 11}


def test_statuses_and_unknown_losses(spark):
    assert _worst("ok", "not converged") == "not converged" and _worst("ok", "ok") == "ok"
    with pytest.raises(ValueError):
        semisup_study.compare(spark.range(3), "id", ["id"], "id", ["id"], [1], 10, loss="quantile")
