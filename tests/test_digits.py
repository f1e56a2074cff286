"""Exact ranks by digits against sorting, with every type, ties, nulls and groups."""

import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramwise.operators import digits, ranks
from gramwise.operators.iterate import exact_median

EVERY = lambda total: F.sequence(F.lit(1).cast("long"), total)


@pytest.mark.parametrize("direct", [2_000_000, 0])
def test_all_ranks_of_doubles_in_groups(spark, monkeypatch, direct):
    monkeypatch.setattr(digits, "_DIRECT_ROWS", direct)
    rng = random.Random(1)
    special = [0.0, -0.0, 1e308, -1e308, 5e-324, -5e-324, math.inf, -math.inf, 1.0, 1.0, 1.0 + 2**-52, -1.0]
    rows = [("a", v) for v in special] + [(None, rng.gauss(0, 10.0 ** rng.randrange(-200, 200))) for _ in range(60)] + [("c", 7.0)] * 40 + [("a", None), ("d", None), ("a", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {}
    for r in digits.select_ranks(df, "v", EVERY, ["k"]).collect():
        got.setdefault(r["k"], {})[r["r"]] = r["value"]
    for k in ("a", None, "c"):
        values = sorted(v for g, v in rows if g == k and v is not None and not math.isnan(v))
        assert [got[k][i + 1] for i in range(len(values))] == values
    assert "d" not in got


@pytest.mark.parametrize("direct", [2_000_000, 0])
@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("int", [3, -2, 3, 2**31 - 1, -(2**31), 0]),
        ("long", [2**62, -(2**62), 2**53 + 1, 2**53, -5, 2**63 - 1, -(2**63)]),
        ("decimal(12,2)", [Decimal("1.25"), Decimal("-3.10"), Decimal("9999999999.99"), Decimal("1.24")]),
        ("date", [datetime.date(1969, 12, 31), datetime.date(2024, 2, 29), datetime.date(1970, 1, 1)]),
        ("timestamp", [datetime.datetime(1960, 1, 1, 0, 0, 1), datetime.datetime(2020, 1, 1, 12), datetime.datetime(1970, 1, 1)]),
        ("float", [1.5, -2.25, 0.0, 3.0]),
    ],
)
def test_types_keep_their_values(spark, monkeypatch, direct, kind, values):
    monkeypatch.setattr(digits, "_DIRECT_ROWS", direct)
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    out = digits.select_ranks(df, "v", EVERY)
    assert dict(out.dtypes)["value"] == dict(df.dtypes)["v"]
    assert [r["value"] for r in out.orderBy("r").collect()] == sorted(values)


def test_edges_levels_and_medians_equal_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)], "v double, k int").repartition(5)
    for k, r in {r["k"]: r for r in exact_median(df, "v", ["k"]).collect()}.items():
        assert r["median"] == pytest.approx(np.median(v[k::3]))
    levels = [0.0, 0.1, 0.5, 0.5, 0.999, 1.0]
    got = ranks.level_quantiles(df, "v", levels).first()["q"]
    assert got == sorted(v)[0:1] + [sorted(v)[int(np.ceil(4000 * a - 1e-9)) - 1] for a in levels[1:]]
    edges = sorted(r["value"] for r in ranks.order_statistic_edges(df, "v", 7).collect())
    at = [1] + [(3999 * k) // 7 + ((3999 * k) % 7 != 0) for k in range(1, 7)] + [4000]
    assert edges == sorted({sorted(v)[i - 1] for i in at})


def test_no_rows_and_no_range_exchange(spark, tmp_path):
    empty = spark.createDataFrame([], "v double, k int")
    assert exact_median(empty, "v", ["k"]).count() == 0 and ranks.order_statistic_edges(empty, "v", 4).count() == 0
    with pytest.raises(TypeError):
        digits.select_ranks(spark.createDataFrame([("x",)], "v string"), "v", EVERY)
    plan = ranks.level_quantiles(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", [0.5])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
