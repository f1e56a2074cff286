"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gramwise.functions import lookups as L, scalars as S
from gramwise.functions.hashing import hash_uniform
from gramwise.operators import intervals as V, ranks as R, sampling as P, shift as H
from gramwise.operators.classify import neighbour_grid
from gramwise.operators.explain import accumulated_effects
from gramwise.operators.moments import least_squares
from gramwise.operators.semisup import calibrated_fit, calibration


def _edges(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return sorted(r["value"] for r in R.order_statistic_edges(df, "x", bins).collect())


def test_quantile_edges_follow_the_rank_rule(spark):
    assert _edges(spark, range(1, 9), 4) == [1, 2, 4, 6, 8]
    assert _edges(spark, [10, 20, 30, 40, 50], 4) == [10, 20, 30, 50]
    assert _edges(spark, [7], 4) == [7]


def test_accumulated_effect_of_a_square(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    rows = accumulated_effects(df, ["x"], lambda c: c["x"] * c["x"], bins=4).orderBy("bin").collect()
    assert [r["eff"] for r in rows] == pytest.approx([-21.125, -18.125, -6.125, 13.875, 41.875])
    assert [r["size"] for r in rows] == [0, 2, 2, 2, 2]
    assert [r["edge"] for r in rows] == [1, 2, 4, 6, 8]


def test_pit_and_quantile_score(spark):
    levels = [0.1, 0.5, 0.9]
    df = spark.createDataFrame([(float(y), [0.0, 1.0, 3.0]) for y in (-1, 0, 0.5, 1, 2, 3, 4)], "y double, q array<double>")
    rows = df.select(L.probability_transform("y", "q", levels).alias("pit"), L.quantile_score("y", "q", levels).alias("crps")).collect()
    assert [r["pit"] for r in rows] == pytest.approx([0, 0, 0.3, 0.5, 0.7, 1, 1])
    assert [r["crps"] for r in rows] == pytest.approx([1.84, 0.64, 0.44, 0.24, 0.64, 1.04, 2.24])


def _small(spark):
    labelled = [(i, float(x), y, True) for i, (x, y) in enumerate([(0, 1.0), (1, 2.0), (2, 2.0), (3, 4.0)])]
    return spark.createDataFrame(labelled + [(10 + i, float(x), None, False) for i, x in enumerate([1, 3, 5, 2])], "id int, x double, y double, lab boolean")


def test_calibration_weights(spark):
    df = _small(spark)
    cal = calibration(df, ["x"], "lab", order=2, c1=0.5)
    w = [r[0] for r in df.where("lab").orderBy("id").select(cal.weight).collect()]
    assert w == pytest.approx([1.5, -0.5, 0.0, 3.0])


def test_calibrated_line_and_plain_line(spark):
    df = _small(spark)
    fit, _ = calibrated_fit(df, ["x"], "y", "lab", order=2, c1=0.5)
    assert fit.first()["theta"] == pytest.approx([1.0, 1.0])
    assert least_squares(df.where("lab"), ["x"], "y").first()["theta"] == pytest.approx([0.9, 0.9])


def test_label_shift_correction(spark):
    rows = []
    for truth, predicted, n in ((0, 0, 80), (0, 1, 20), (1, 0, 30), (1, 1, 70)):
        rows += [(truth, predicted, ["train", "calibration"])] * n
    rows += [(0, 0, ["target"])] * 60 + [(0, 1, ["target"])] * 40
    df = spark.createDataFrame(rows, "label int, predicted int, split array<string>")
    prior = {r["label"]: r for r in H.corrected_prior(df, "split", "label", "predicted", [0, 1]).collect()}
    assert (prior[0]["target"], prior[1]["target"]) == pytest.approx((0.6, 0.4))
    assert (prior[0]["source"], prior[1]["source"]) == pytest.approx((0.5, 0.5))
    p = spark.range(1).select(H.reweighted_posterior(F.lit(0.6), [0.5, 0.5], [0.6, 0.4])).first()[0]
    assert p == pytest.approx(0.5)


def test_kolmogorov_smirnov(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.7,), (0.9,)], "u double")
    assert R.uniform_ks(df, "u").first()["ks"] == pytest.approx(0.2)


def test_systematic_copies(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "id int, w double")
    rows = P.weighted_copies(df, ["id"], "w", 4, 0.5).orderBy("id").collect()
    assert [r["copies"] for r in rows] == [0, 1, 1, 2]


def test_levels_regions_and_grids(spark):
    assert len(V.interval_levels()) == 21
    grid = spark.range(1).select(F.explode(S.integer_grid(-45, 45, 10.0)).alias("x"))
    assert grid.count() == 91
    assert grid.where((F.col("x") >= -1) & (F.col("x") <= 1)).count() == 21
    assert len(H.penalty_grid(500)) == 14 and len(H.penalty_grid(1100)) == 15
    assert neighbour_grid(1000) == [5, 24, 43, 63, 82, 101, 120, 139, 158, 177]
    assert neighbour_grid(10000) == [10, 120, 230, 340, 450, 560, 670, 780, 890, 1000]


def test_hash_is_fixed(spark):
    assert spark.range(1).select(hash_uniform(F.lit(5), 7)).first()[0] == pytest.approx(0.043465694645, abs=1e-12)


def test_band_and_grids(spark):
    row = spark.range(1).select(
        S.band(F.lit(1.0), F.lit(3.0), 1.0)[0].alias("lo"), S.geometric_grid(0.1, 2.0, 3).alias("g"), S.linspace(0.0, 1.0, 5).alias("l"),
        S.level_set([0.25, 0.5], [0.5, 0.75]).alias("s"), S.config_key(F.lit("a"), F.lit(1)).alias("k"),
    ).first()
    assert row["lo"] == pytest.approx(1 - 3.92)
    assert row["g"] == pytest.approx([0.1, 0.2, 0.4]) and row["l"] == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert row["s"] == [0.25, 0.5, 0.75] and row["k"] == "a_1"
