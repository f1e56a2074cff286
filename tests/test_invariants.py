"""Properties of samples, ranks, joins and scores on small random tables, and of the plans they produce."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators import encode as E, intervals as V, neighbors as N, ranks as R, sampling as P
from gramwise.operators.explain import accumulated_effects
from gramwise.operators.moments import moments
from gramwise.sources import readers, writers


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    # One group and one value hold a third of the rows and more.
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.uniform(size=n) < 0.6, "hot", rng.choice(list("abc"), n)), "v": np.where(rng.uniform(size=n) < 0.4, 1.0, rng.normal(size=n).round(2))})
    return pdf, spark.createDataFrame(pdf).persist()


def test_prefix_sums_with_hot_groups_and_values(rows):
    pdf, df = rows
    got = R.prefix(df, ["v", "id"], "id", ["g"]).toPandas().sort_values(["g", "v", "id"])
    want = pdf.sort_values(["g", "v", "id"])
    assert list(got["rank"]) == list(want.groupby("g").cumcount() + 1)
    assert list(got["through"]) == list(want.groupby("g")["id"].cumsum())
    assert list(got["before"] + want["id"].to_numpy()) == list(got["through"])
    assert dict(zip(got["g"], got["total"])) == want.groupby("g")["id"].sum().to_dict()


def test_samples_do_not_depend_on_partitioning(rows):
    _, df = rows
    one = {r["id"] for r in P.cap_rows(df.repartition(1), "id", 100, 5).collect()}
    many = {r["id"] for r in P.cap_rows(df.repartition(13), "id", 100, 5).collect()}
    assert one == many and len(one) == 100
    rest = P.complement(df, P.cap_rows(df, "id", 100, 5), "id")
    assert rest.count() == 2900


@pytest.mark.parametrize("size", [0, 1, 2999, 3000, 5000])
def test_sample_sizes_are_exact(rows, size):
    _, df = rows
    assert P.cap_rows(df, "id", size, 2).count() == min(size, 3000)


def test_strata_and_seeds_have_exact_sizes(rows):
    pdf, df = rows
    taken = P.stratified_split(df, "id", "g", 0.2, 3).where("is_calibration").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in taken} == {g: round(0.2 * k + 1e-9) for g, k in pdf.groupby("g").size().items()}
    seeds = P.seed_samples(df, "id", 70, [1, 2, 3]).where("is_labelled").groupBy("seed").count().collect()
    assert sorted(r["count"] for r in seeds) == [70, 70, 70]
    assert P.seed_samples(df, "id", 9999, [1]).where("is_labelled").count() == 3000


def test_folds_partition_the_rows(rows):
    _, df = rows
    sizes = [r["count"] for r in P.kfold(df, "id", 7, 1, balanced=True).groupBy("fold").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 1


def test_resampling_returns_exactly_n_rows_even_with_one_heavy_row(rows, monkeypatch):
    _, df = rows
    monkeypatch.setattr(P, "_COPIES_PER_ROW", 50)
    heavy = df.withColumn("w", F.when(F.col("id") == 7, 5000.0).otherwise(0.37))
    out = P.weighted_resample(heavy, ["id"], "w", 2000, 0.3)
    assert out.count() == 2000
    copies = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m"))
    assert copies.where((F.col("n") != F.col("d")) | (F.col("n") != F.col("m"))).count() == 0


def test_neighbour_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(150), "v": list(rng.integers(0, 3, size=(150, 2)).astype(float)), "y": rng.integers(0, 3, 150)})
    df = spark.createDataFrame(pdf)
    query, ref = df.where("id < 60"), df.where("id >= 60")
    one = N.nearest_join(query, ref, 4, "id", "id", "v", "y").orderBy("qid").collect()
    two = N.nearest_join(query, ref, 4, "id", "id", "v", "y", block_rows=16, broadcast_bytes=0).orderBy("qid").collect()
    assert one == two
    v = np.stack(pdf["v"])
    for r in one:
        d = ((v[60:] - v[r["qid"]]) ** 2).sum(axis=1)
        assert [x["rid"] for x in r["neighbours"]] == list(60 + np.lexsort((np.arange(90), d))[:4])
    a = N.kernel_smooth(query, ref, "id", "id", "v", "y", [0.5]).orderBy("qid").collect()
    b = N.kernel_smooth(query, ref, "id", "id", "v", "y", [0.5], block_rows=16, broadcast_bytes=0).orderBy("qid").collect()
    assert [x["smooth"][0] for x in a] == pytest.approx([x["smooth"][0] for x in b])


def test_vote_prefers_the_smallest_label_on_ties(spark):
    df = spark.createDataFrame([([(0.1, 1, 2.0), (0.2, 2, 1.0), (0.3, 3, 1.0)],)], "n array<struct<dist:double,rid:long,payload:double>>")
    assert df.select(N.vote("n", 2, [0, 1, 2]), N.vote("n", 1, [0, 1, 2]), N.vote("n", 3, [0, 1, 2])).first()[0:3] == (1, 2, 1)


def test_effect_curve_is_centred(rows):
    _, df = rows
    out = accumulated_effects(df, ["v"], lambda c: c["v"] * c["v"] + c["v"], bins=8).orderBy("bin").collect()
    mids = [(out[i]["eff"] + out[i - 1]["eff"]) / 2 for i in range(1, len(out))]
    assert sum(r["size"] * m for r, m in zip(out[1:], mids, strict=True)) == pytest.approx(0.0, abs=1e-6)


def test_coverage_grows_with_the_level_and_scores_are_not_negative(rows):
    _, df = rows
    levels = V.interval_levels()
    scored = df.withColumn("q", V.gaussian_quantiles(F.lit(0.3), F.lit(0.5), 0.2, levels))
    out = V.interval_summary(scored, "v", "q", levels).first()
    found = [out[f"cov_{round(100 * c)}"] for c in V.NOMINAL]
    assert found == sorted(found)
    assert V.scored_rows(scored, "v", "q", levels).where((F.col("crps") < 0) | (F.col("pit") < 0) | (F.col("pit") > 1)).count() == 0


def test_bad_arguments_raise(spark, rows):
    _, df = rows
    with pytest.raises(ValueError):
        E.split_target(df, "absent")
    with pytest.raises(ValueError):
        E.flip_labels("v", "id", 1.5)
    with pytest.raises(ValueError):
        E.require_same_width(["a"], ["a", "b"])
    with pytest.raises(Exception, match="not numeric"):
        E.to_double(df, ["g"]).agg(F.sum("g")).collect()


def test_flip_with_zero_rate_changes_nothing(rows):
    _, df = rows
    labels = df.withColumn("l", (F.col("v") > 0).cast("int"))
    assert labels.where(E.flip_labels("l", "id", 0.0) != F.col("l")).count() == 0


def test_attribute_table_quotes_and_nulls(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("% c\n@relation r\n@attribute 'the name' {x,'y z'}\n@ATTRIBUTE v REAL\n@data\n\n'y z',1.5\nx,?\n")
    rows = readers.read_attribute_table(spark, str(tmp_path / "t")).orderBy("the name").collect()
    assert [tuple(r) for r in rows] == [("x", None), ("y z", 1.5)]


def test_results_are_replaced_per_partition(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.write_results(df, path, ["k"])
    writers.write_results(df.where("k = 'a'").withColumn("v", F.lit(9)), path, ["k"])
    assert {r["k"]: r["v"] for r in readers.read_results(spark, path).collect()} == {"a": 9, "b": 2}


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_moments_shuffle_once_and_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).select("id", *[F.rand(i).alias(f"c{i}") for i in range(6)]).write.parquet(path)
    plan = _plan(moments(spark.read.parquet(path), ["c0"], ["c1"], by=[]))
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 3 and "CartesianProduct" not in plan
    assert "c5" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_ranks_have_no_single_partition_window_over_rows(rows):
    _, df = rows
    plan = _plan(R.prefix(df, ["id"], by=["g"]))
    windows = [line for line in plan.split("\n") if "Exchange SinglePartition" in line]
    assert not windows


def test_sample_flag_needs_no_shuffle(rows):
    _, df = rows
    assert "Exchange" not in _plan(df.withColumn("s", P.within_hash_rank(df, "id", 50, 1)))
